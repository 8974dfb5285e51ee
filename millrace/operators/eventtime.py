"""Event time: watermarks, late rows and closed windows.

The batch rule takes rows in arrival order. After each `every` accepted places the watermark becomes the largest time
so far less the slack, and a row before the watermark is dropped, before any operator sees it. With every = 1 that is a
running maximum, a window function; for other schedules rows that are dropped still count and skip a scheduled
watermark, which only a fold in order can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def watermark(df: DataFrame, time: str, slack: str) -> DataFrame:
    return df.withWatermark(time, slack)


def ingestion(df: DataFrame, name: str = "_t") -> DataFrame:
    """Stamps rows with the time of their batch."""
    return df.withColumn(name, F.current_timestamp())


def drop_late(df: DataFrame, time: str, slack: str, arrival: str, keys: list[str] = ()) -> DataFrame:
    """Rows that are not before the running watermark of the rows that arrived earlier. By `keys` if given: without
    them all rows are one sequence, whose running maximum is a task's work."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(F.col(time)).over(before) - F.expr(f"INTERVAL {slack}")
    return df.withColumn("_mark", mark).where(F.col("_mark").isNull() | (F.col(time) >= F.col("_mark"))).drop("_mark")


def drop_late_every(df: DataFrame, time: str, slack_us: int, every: int, arrival: str, keys: list[str] = ()) -> DataFrame:
    """The schedule of a batch source: at every `every`-th row that is not late the watermark follows the latest time.

    A fold in arrival order, key by key (without keys: in one task)."""

    def fold(pdf):
        pdf = pdf.sort_values(arrival, kind="stable")
        latest = mark = None
        keep = []
        for i, t in enumerate(pdf[time].astype("datetime64[us]").astype("int64")):
            late = mark is not None and t < mark
            keep.append(not late)
            if late:
                continue
            latest = t if latest is None else max(latest, t)
            if (i + 1) % every == 0:
                mark = latest - slack_us
        return pdf[keep]

    return df.groupBy(*keys).applyInPandas(fold, df.schema)


def closed_only(windows: DataFrame, rows: DataFrame, time: str, slack: str, end: str = "end") -> DataFrame:
    """Windows that end before the last watermark; the rest would still be open at the end of a stream."""
    last = rows.agg((F.max(time) - F.expr(f"INTERVAL {slack}")).alias("_last"))
    return windows.crossJoin(F.broadcast(last)).where(F.col(end) < F.col("_last")).drop("_last")  # one row


def bucket(time: Column, length_us: int) -> Column:
    """floor(time / length), also before the epoch."""
    us = F.unix_micros(time.cast("timestamp"))
    return F.floor((us - F.pmod(us, F.lit(length_us))) / length_us)
