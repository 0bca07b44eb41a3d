"""Cut lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (in local mode a temporary one where that is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For large tables of names.
SMALL = {"compression": "zstd"}
#: For lists of growing longs: their differences take a few bits each.
DIFFERENCES = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df to a new scratch table and reads it back."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)
