"""Breakdowns, directory rollups, trees and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language")


def file_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("file_count"))


def symbol_count_by(symbols: DataFrame, keys: list[str]) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.count("*").alias("symbols"))


def directory_rollup(files: DataFrame, depth: int = 0) -> DataFrame:
    """Per directory: files and bytes beneath it; depth 0 means all levels."""
    parts = F.split("path", "/")
    most = F.size(parts) - 1 if depth == 0 else F.least(F.size(parts) - 1, F.lit(depth))
    dirs = F.when(most >= 1, F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return files.select("project", "size", F.explode(dirs).alias("dir")).groupBy("project", "dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def tree_lines(files: DataFrame, depth: int = 0) -> DataFrame:
    """A line per file and directory in pre-order: project, parts (the order), line.  At the depth limit directories stand alone."""
    parts = F.split("path", "/")
    most = F.size(parts) if depth == 0 else F.least(F.size(parts), F.lit(depth))
    own = files.select("project", parts.alias("p"), most.alias("most"))
    nodes = own.select("project", F.explode(F.transform(F.sequence(F.lit(1), "most"), lambda k: F.struct(F.slice("p", 1, k).alias("parts"), (k < F.size("p")).alias("is_dir")))).alias("n")).select("project", "n.*").distinct()
    nodes = nodes.withColumns({"parent": F.slice("parts", 1, F.size("parts") - 1), "name": F.element_at("parts", -1)})
    nodes = nodes.withColumn("is_last", F.lead("name").over(Window.partitionBy("project", "parent").orderBy("name")).isNull())
    above = nodes.where(F.size("parts") > 1).select("project", "parts", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.slice("parts", 1, k))).alias("anc"))
    lasts = above.join(nodes.select("project", F.col("parts").alias("anc"), F.col("is_last").alias("last")), ["project", "anc"])
    indent = lasts.groupBy("project", "parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.size("anc").alias("k"), "last"))), lambda x: F.when(x["last"], "    ").otherwise("│   ")), "").alias("indent"))
    out = nodes.join(indent, ["project", "parts"], "left")
    line = F.concat(F.coalesce("indent", F.lit("")), F.when(F.col("is_last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    return out.select("project", "parts", line.alias("line"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, path, status) of files added, changed (size, modified or content) or deleted."""
    cols = [c for c in ("size", "modified") if c in old.columns and c in new.columns]

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select("project", "path", F.lit(True).alias(side), F.struct(*cols, F.sha2(F.encode("content", "UTF-8"), 256).alias("hash")).alias(f"{side}_state"))

    both = keyed(old, "old").join(keyed(new, "new"), ["project", "path"], "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old_state").eqNullSafe(F.col("new_state")), "changed")
    return both.select("project", "path", status.alias("status")).where("status is not null")
