"""Annotation documents: three JSON maps, and the table annotations(project, target, path, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import split_symbol_key

SCHEMA = "project string, file_definitions map<string,string>, file_marks map<string,array<string>>, symbol_definitions map<string,string>"
TARGETS = {"file_definition": "file_definitions", "file_mark": "file_marks", "symbol_definition": "symbol_definitions"}


def exploded(docs: DataFrame) -> DataFrame:
    """Documents with the three maps (each may be missing) -> one row per entry; a symbol key splits at its last '::'."""
    empty = "coalesce({0}, map())"
    files = docs.selectExpr("project", "'file_definition' as target", f"explode({empty.format('file_definitions')}) as (path, value)").selectExpr("project", "target", "path", "cast(null as string) as name", "value")
    marks = docs.selectExpr("project", f"explode({empty.format('file_marks')}) as (path, marks)").selectExpr("project", "'file_mark' as target", "path", "cast(null as string) as name", "explode(marks) as value")
    path, name = split_symbol_key(F.col("key"))
    symbols = docs.selectExpr("project", "'symbol_definition' as target", f"explode({empty.format('symbol_definitions')}) as (key, value)").select("project", "target", path.alias("path"), name.alias("name"), "value")
    return files.unionByName(marks).unionByName(symbols)


def read_annotations(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    docs = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return exploded(docs.withColumn("project", F.coalesce("project", F.lit(project))))


def documents_of(annotations: DataFrame) -> DataFrame:
    """One document per project; entries without a value are left out."""
    a = annotations.where("value is not null")
    files = a.where("target = 'file_definition'").groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("file_definitions"))
    marks = a.where("target = 'file_mark'").groupBy("project", "path").agg(F.array_sort(F.collect_set("value")).alias("marks")).groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("path", "marks"))).alias("file_marks"))
    symbols = a.where("target = 'symbol_definition'").groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("path", F.lit("::"), "name"), "value"))).alias("symbol_definitions"))
    return files.join(marks, "project", "full").join(symbols, "project", "full")


def write_annotations(annotations: DataFrame, path: str) -> None:
    documents_of(annotations).write.mode("overwrite").json(path)
