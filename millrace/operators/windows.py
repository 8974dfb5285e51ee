"""Window assigners: tumbling, sliding and session by event time, counting and moving by number of elements.

Time windows are aligned to the epoch (or to `after`), hold [start, end) and carry their end as event time. Count
windows number a key's elements by time and a tiebreak; only full windows are emitted unless `partial`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregators import Aggregator, folded


@dataclass(frozen=True)
class Tumbling:
    length: str
    after: str | None = None

    def column(self, time: Column) -> Column:
        return F.window(time, self.length, self.length, self.after) if self.after else F.window(time, self.length)


@dataclass(frozen=True)
class Sliding:
    length: str
    step: str
    after: str | None = None

    def column(self, time: Column) -> Column:
        return F.window(time, self.length, self.step, self.after) if self.after else F.window(time, self.length, self.step)


@dataclass(frozen=True)
class Session:
    gap: str

    def column(self, time: Column) -> Column:
        return F.session_window(time, self.gap)


@dataclass(frozen=True)
class Counting:
    length: int
    partial: bool = False


@dataclass(frozen=True)
class Moving:
    length: int
    step: int
    partial: bool = False


Assigner = Tumbling | Sliding | Session | Counting | Moving


def aggregate(df: DataFrame, assigner: Assigner, aggregators: dict[str, tuple[Aggregator, Column]], keys: list[str] = (), time: str = "_t", tiebreak: list[str] = ()) -> DataFrame:
    """One row for each key and window: keys, `start`, `end` (count windows: `window`, `size`), results by name."""
    keys = list(keys)
    if isinstance(assigner, Tumbling | Sliding) and not df.isStreaming and all(a.monoid for a, _ in aggregators.values()):
        out = folded(df, [*keys, assigner.column(F.col(time)).alias("_w")], aggregators, F.col(time))
        return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggregators)
    if isinstance(assigner, Tumbling | Sliding | Session):
        made = [a.over(v, F.col(time)).alias(n) for n, (a, v) in aggregators.items()]
        out = df.groupBy(*keys, assigner.column(F.col(time)).alias("_w")).agg(*made)
        return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggregators)
    order = Window.partitionBy(*keys).orderBy(time, *tiebreak)
    number = F.row_number().over(order) - 1
    numbered = df.withColumn("_n", number.cast("long"))
    step = assigner.step if isinstance(assigner, Moving) else assigner.length
    if step == assigner.length:
        numbered = numbered.withColumn("window", F.floor(F.col("_n") / step))
    else:
        first = F.greatest(F.lit(0), F.ceil((F.col("_n") - assigner.length + 1) / step))
        last = F.floor(F.col("_n") / step)  # before `first` where elements are skipped between windows
        ids = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        numbered = numbered.withColumn("window", F.explode(ids))
    made = [a.over(v, F.struct(F.col(time), F.col("_n"))).alias(n) for n, (a, v) in aggregators.items()]
    out = numbered.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("size"), *made)
    return out if assigner.partial else out.where(F.col("size") == assigner.length)
