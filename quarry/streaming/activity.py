"""Live counts of the request log: sessions by window, kept as a table while the log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.history import activity_windows

SCHEMA = "session_id long, window_start timestamp, entries long, last_active timestamp, batch long"


def maintain_activity(history: DataFrame, path: str, checkpoint: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", once: bool = True):
    """A streaming query that writes, for each micro-batch, the windows that it changed, with their counts so far, to a folder of its own under path.  A batch
    that runs again replaces its folder.  Entries later than `late` are dropped, and windows that no entry in time can reach leave the state."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = activity_windows(history, size, slide, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_activity(spark: SparkSession, path: str) -> DataFrame:
    """session_id, window_start, entries, last_active: each window as its last batch left it."""
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    last = F.max_by(F.struct("entries", "last_active"), "batch").alias("e")
    return rows.groupBy("session_id", "window_start").agg(last).select("session_id", "window_start", "e.*")


def compact_activity(spark: SparkSession, path: str, to: str) -> None:
    """The current state alone, as one batch of a new table."""
    current_activity(spark, path).write.mode("overwrite").parquet(f"{to}/batch=0")
