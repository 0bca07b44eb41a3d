"""File tables: project, path, size, modified, language, content, readable."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import language_of
from quarry.operators.scratch import stored

MAX_FILE_SIZE = 1_000_000


def load_files(df: DataFrame) -> DataFrame:
    """A corpus table (project, path, content; modified where there is one) as files.  Content may be binary; what is not UTF-8 is
    listed with null content."""
    modified = F.col("modified").cast("timestamp") if "modified" in df.columns else F.lit(None).cast("timestamp")
    raw = F.col("content").cast("binary")
    text = F.try_validate_utf8(raw.cast("string"))
    return df.select("project", "path", F.octet_length(raw).cast("long").alias("size"), modified.alias("modified"), language_of(F.col("path")).alias("language"), text.alias("content"), text.isNotNull().alias("readable"))


def scan_files(spark: SparkSession, root: str, project: str, max_file_size: int = MAX_FILE_SIZE, tasks: int = 64) -> DataFrame:
    """All files under a folder that the executors see, hidden and underscore names included (Spark's own listing drops those).
    Larger files are left out.  Folders are listed level by level by the tasks, then the paths are dealt out and read, a file at a time."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["at"]:
                with os.scandir(at) as entries:
                    rows = [(e.path, e.is_dir(follow_symlinks=False)) for e in entries]
                yield pd.DataFrame(rows, columns=["at", "folder"]).astype({"at": "object", "folder": "bool"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["at"]:
                if not os.path.isfile(p) or (st := os.stat(p)).st_size > max_file_size:
                    continue
                with open(p, "rb") as f:
                    yield pd.DataFrame([(project, os.path.relpath(p, root), datetime.fromtimestamp(st.st_mtime, UTC), f.read())], columns=["project", "path", "modified", "content"])

    level, found = spark.createDataFrame([(root,)], "at string"), []
    while level.take(1):
        here = stored(level.repartition(tasks).mapInPandas(listed, "at string, folder boolean"), "listing")
        found.append(here.where("not folder").select("at"))
        level = here.where("folder").select("at")
    return load_files(reduce(DataFrame.unionByName, found).repartition(tasks).mapInPandas(read, "project string, path string, modified timestamp, content binary"))


def write_index(tables: dict[str, DataFrame], path: str, rows_per_file: int = 1_000_000) -> None:
    """Each table to path/name, by project; a project's rows are spread over as many files as it needs."""
    for name, df in tables.items():
        df = stored(df, "to-index")  # it is read twice; what it comes from runs once
        size = df.groupBy("project").agg(F.ceil(F.count("*") / rows_per_file).alias("pieces")).selectExpr("project as of", "pieces")
        spread = df.join(size, F.col("project").eqNullSafe(F.col("of")))
        spread = spread.withColumn("piece", F.pmod(F.xxhash64(*[c for c in df.columns if c in ("path", "name", "start_byte")] or [F.lit(0)]), F.col("pieces")))
        spread.repartition("project", "piece").select(*df.columns).write.mode("overwrite").partitionBy("project").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
