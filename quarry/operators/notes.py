"""Annotation logs folded to their current state, and annotations attached to files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import normalize_mark

TARGET = ["project", "path", "name"]


def of_known(log: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events whose target is among the known ones; null keys are alike."""
    keys = keys or ["project", "path"]
    own = known.select(*[F.col(k).alias(f"known_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]
    return log.join(own, same, "left_semi")


def definition_events(log: DataFrame, known: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """log (project, path, name, ts, seq, op, value) with accepted: define only while nothing is set, redefine always.  With `known`, a table of the
    targets that there are, by `keys` (project and path), an event of any other target is not accepted."""
    by = Window.partitionBy(*TARGET).orderBy("ts", "seq")
    accepted = (F.col("op") == "redefine") | (F.row_number().over(by) == 1)
    if known is None:
        return log.withColumn("accepted", accepted)
    own = known.select(*[F.col(k).alias(f"known_{k}") for k in keys or ["project", "path"]]).distinct().withColumn("is_known", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys or ["project", "path"]]
    return log.join(own, same, "left").withColumn("accepted", F.coalesce("is_known", F.lit(False)) & accepted).select(*log.columns, "accepted")


def fold_definitions(log: DataFrame, known: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The current value of each target, without a window: the last redefine, or else the first event.  With `known`, of known targets only."""
    log = log if known is None else of_known(log, known, keys)
    last = F.max_by(F.when(F.col("op") == "redefine", F.col("value")), F.when(F.col("op") == "redefine", F.struct("ts", "seq")))
    return log.groupBy(*TARGET).agg(last.alias("last"), F.max(F.col("op") == "redefine").alias("any"), F.min_by("value", F.struct("ts", "seq")).alias("first")).select(*TARGET, F.when(F.col("any"), F.col("last")).otherwise(F.col("first")).alias("value"))


def fold_marks(log: DataFrame) -> DataFrame:
    """Per file its marks in first-seen order; unknown ones are rejected."""
    known = log.withColumn("mark", normalize_mark(F.col("mark"))).where("mark is not null")
    first = known.groupBy("project", "path", "mark").agg(F.min(F.struct("ts", "seq")).alias("at"))
    return first.groupBy("project", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mark"))), lambda x: x["mark"]).alias("marks"))


def rejected_marks(log: DataFrame) -> DataFrame:
    return log.where(normalize_mark(F.col("mark")).isNull())


def merge_marks(held: DataFrame, new: DataFrame) -> DataFrame:
    """Adds marks that are absent; both sides (project, path, marks)."""
    both = held.join(new.withColumnRenamed("marks", "more"), ["project", "path"], "full")
    none = F.array().cast("array<string>")
    return both.select("project", "path", F.array_union(F.coalesce("marks", none), F.coalesce("more", none)).alias("marks"))


def reject_missing(log: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events whose target is not indexed."""
    keys = keys or ["project", "path"]
    return log.join(known.select(*keys).distinct(), keys, "left_anti")


def attach_annotations(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """files with definition and marks of the annotation table."""
    own = annotations.groupBy("project", "path").agg(
        F.max(F.when(F.col("target") == "file_definition", F.col("value"))).alias("definition"),
        F.array_sort(F.collect_set(F.when(F.col("target") == "file_mark", F.col("value")))).alias("marks"),
    )
    return files.join(own, ["project", "path"], "left")


def attach_symbol_annotations(symbols: DataFrame, annotations: DataFrame) -> DataFrame:
    own = annotations.where("target = 'symbol_definition'").groupBy("project", "path", "name").agg(F.max("value").alias("definition"))
    return symbols.join(own, ["project", "path", "name"], "left")


def annotation_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("target").agg(F.count("*").alias("entries"))
