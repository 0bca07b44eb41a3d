"""Symbol tables clustered by (project, path, name), so that a few symbols are found in a few row groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.scratch import stored

KEYS = ["project", "path", "name"]
ROWS_PER_FILE, ROWS_PER_GROUP = 2_000_000, 20_000
#: Keys up to this number go into the scan's own conditions; more are joined with the whole table.
FEW = 2_000


def write_clustered(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, rows_per_group: int = ROWS_PER_GROUP) -> None:
    """Writes a table of symbols in ranges of (project, path, name, start_byte), sorted, in small row groups: those of a file's symbols are told by the bounds of
    `path`, those of a name by a Bloom filter of `name` (or its dictionary).  Ranges are cut by rows, so a hot project or path is spread over several."""
    rows = stored(rows, "to-cluster")  # counting, sampling the ranges and writing read the rows three times; what they come from runs once
    order = KEYS + [c for c in ("start_byte",) if c in rows.columns]
    files = max(1, math.ceil(rows.count() / rows_per_file))
    writer = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite")
    # The adaptive filter takes the size that a group's different names need, up to the bound.
    bloom = {"parquet.bloom.filter.enabled#name": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.fpp#name": "0.01", "parquet.bloom.filter.max.bytes": str(max(1024, 4 * rows_per_group))}
    writer.options(**bloom, **{"parquet.block.row.count.limit": str(rows_per_group)}).parquet(path)


def lookup(spark: SparkSession, path: str, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """The symbols with the wanted (project, path, name); repeated keys count once, null projects match null ones, null paths and names nothing.

    Up to `few` different keys are read by the driver and given to the scan, which skips row groups by the bounds of path and the filter of name; the rows
    that are left are joined.  More keys are joined with the whole table.
    """
    table = spark.read.parquet(path)
    keys = wanted.select(*KEYS).where("path is not null and name is not null").distinct()
    held = keys.limit(few + 1).collect()
    own = keys.select(*[F.col(c).alias(f"wanted_{c}") for c in KEYS])
    if len(held) <= few:
        table = table.where(F.col("path").isin(sorted({r["path"] for r in held})) & F.col("name").isin(sorted({r["name"] for r in held})))
        own = F.broadcast(spark.createDataFrame(held, own.schema))  # `few` rows at most
    same = F.col("project").eqNullSafe(F.col("wanted_project")) & (F.col("path") == F.col("wanted_path")) & (F.col("name") == F.col("wanted_name"))
    return table.join(own, same, "left_semi")


def lookup_names(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All symbols with one of these names, wherever they are: row groups whose filter holds none of them are skipped."""
    return spark.read.parquet(path).where(F.col("name").isin(names))


def found(spark: SparkSession, path: str, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """Each different wanted key with n_symbols, the number of symbols that it names; 0 for one that is not found."""
    hit = lookup(spark, path, wanted, few).groupBy(*KEYS).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"own_{c}") for c in KEYS], "n")
    same = F.col("project").eqNullSafe(F.col("own_project")) & (F.col("path") == F.col("own_path")) & (F.col("name") == F.col("own_name"))
    return wanted.select(*KEYS).distinct().join(hit, same, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("n_symbols"))
