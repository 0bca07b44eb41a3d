"""The request log: sessions, tails and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.symbols import dedup_symbols


def session_history(history: DataFrame, session_id, limit: int = 50) -> DataFrame:
    """The last entries of one session, in time order."""
    last = history.where(F.col("session_id") == session_id).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
    return last.orderBy("ts", "seq")


def all_history(history: DataFrame, limit: int = 50) -> DataFrame:
    """The last entries of each session with the session's latest entry, by which the sessions are ordered."""
    by = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
    tail = history.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return tail.withColumn("latest", F.max("ts").over(Window.partitionBy("session_id")))


def ordered(tails: DataFrame) -> DataFrame:
    return tails.orderBy(F.desc("latest"), "session_id", "ts", "seq")


def session_summary(history: DataFrame) -> DataFrame:
    return history.groupBy("session_id").agg(F.min("project").alias("project"), F.min("ts").alias("created_at"), F.max("ts").alias("last_active"), F.count("*").alias("history_count"))


def totals(history: DataFrame, projects: DataFrame) -> DataFrame:
    return projects.agg(F.count_distinct("project").alias("projects")).crossJoin(F.broadcast(history.agg(F.count_distinct("session_id").alias("active_sessions"))))  # one row each


def project_summary(files: DataFrame, symbols: DataFrame, history: DataFrame) -> DataFrame:
    f = files.groupBy("project").agg(F.count("*").alias("file_count"))
    s = dedup_symbols(symbols).groupBy("project").agg(F.count("*").alias("symbol_count"))
    h = history.groupBy("project").agg(F.count_distinct("session_id").alias("session_count"), F.max("ts").alias("last_active"))
    return f.join(s, "project", "full").join(h, "project", "full").na.fill(0, ["file_count", "symbol_count", "session_count"])


def orphan_sessions(history: DataFrame, projects: DataFrame) -> DataFrame:
    return history.join(projects.select("project").distinct(), "project", "left_anti").select("session_id").distinct()


def activity_windows(history: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Entries and last activity per session in tumbling or sliding windows; for a stream give the watermark."""
    own = history.withWatermark("ts", late) if late else history
    return own.groupBy("session_id", F.window("ts", size, slide or size)).agg(F.count("*").alias("entries"), F.max("ts").alias("last_active")).select("session_id", F.col("window.start").alias("window_start"), "entries", "last_active")
