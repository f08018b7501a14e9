"""Live traces by Structured Streaming: visits, counts, repeats, bursts.

Each function takes a streaming frame (it also takes a bounded one) and returns
one; the caller chooses source, sink and checkpoint folder. State is bounded by
the watermark: rows later than ``late`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def without_future(rows: DataFrame, at: str, now: Column, slack_min: float = 5.0) -> DataFrame:
    """Rows no more than the slack ahead of ``now``."""
    return rows.where(F.col(at) <= now + F.expr(f"INTERVAL {int(slack_min * 60)} SECONDS"))


def visits(rows: DataFrame, keys: list[str], at: str, gap_min: float = 30.0, tail_min: float = 5.0, late: str = "1 day") -> DataFrame:
    """Session windows: runs of rows less than gap_min apart, ending tail_min
    behind the last. The window's own end is the last row plus the gap."""
    window = F.session_window(F.col(at), f"{int(gap_min * 60)} seconds")
    found = rows.withWatermark(at, late).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("points"))
    shift = F.expr(f"INTERVAL {int((gap_min - tail_min) * 60)} SECONDS")
    return found.select(*keys, F.col("w.start").alias("start"), (F.col("w.end") - shift).alias("end"), "points")


def counts(rows: DataFrame, keys: list[str], at: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows in each tumbling window."""
    found = rows.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("w.start").alias("start"), "n")


def bursts(rows: DataFrame, keys: list[str], at: str, least: int = 8, late: str = "1 hour") -> DataFrame:
    """Three-minute windows, a minute apart, with at least ``least`` rows; ``minute``
    is the middle one."""
    found = rows.withWatermark(at, late).groupBy(*keys, F.window(at, "3 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("near"))
    return found.where(F.col("near") >= least).select(*keys, (F.col("w.start") + F.expr("INTERVAL 1 MINUTE")).alias("minute"), "near")


def first_of_key(rows: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def to_partitions(rows: DataFrame, path: str, checkpoint: str, by: list[str], once: bool = True):
    """Start appending to a partitioned table; ``once`` takes what is there and ends."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
