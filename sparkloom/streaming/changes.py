"""Change streams: batches by a quiet gap and a longest wait, coalesced folders. debounce.py has the delay that grows with what waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, gap: str = "400 milliseconds", late: str | None = None, key: str = "source", time: str = "ts") -> DataFrame:
    """(source, opened, closed, n): a batch closes after a quiet gap. For streams give the watermark's delay."""
    rows = events.withWatermark(time, late) if late else events
    made = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def debounced_with_limit(events: DataFrame, gap_ms: int = 400, most_ms: int = 2000, key: str = "source", time: str = "ts") -> DataFrame:
    """Batches of a stored change table that also end most_ms after their first event: sessions cut at multiples of it."""
    by = Window.partitionBy(key).orderBy(time, "event_id")
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    rows = events.withColumn("__new", F.coalesce(ms - F.lag(ms).over(by) >= gap_ms, F.lit(True)).cast("int"))
    rows = rows.withColumn("__session", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(ms).over(Window.partitionBy(key, "__session"))
    rows = rows.withColumn("__cut", F.floor((ms - start) / most_ms))
    return rows.groupBy(key, "__session", "__cut").agg(F.min(ms).alias("opened_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("n")).drop("__session", "__cut")


def coalesced(batches: DataFrame, least: int = 12, levels: int = 2) -> DataFrame:
    """(batch, shown): the distinct folders (one or two levels) of a batch (batch, path) of least paths or more, else its paths."""
    folder = F.regexp_extract("path", rf"^((?:[^/]+/){{1,{levels}}})", 1)
    rows = batches.withColumn("folder", F.when(folder == "", F.col("path")).otherwise(F.regexp_replace(folder, "/$", "")))
    made = rows.groupBy("batch").agg(F.count_distinct("path").alias("n"), F.sort_array(F.collect_set("folder")).alias("folders"), F.sort_array(F.collect_set("path")).alias("paths"))
    return made.select("batch", "n", F.when(F.col("n") >= least, F.col("folders")).otherwise(F.col("paths")).alias("shown"))


def tumbling(events: DataFrame, size: str = "10 minutes", key: str = "event_type", late: str | None = None) -> DataFrame:
    """(key, opened, n) per window of event time; with a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("opened"), "n")
