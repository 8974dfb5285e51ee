"""Streams: fluent wrappers of batch or streaming DataFrames with an event-time column and, if keyed, key columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import joins, windows
from .aggregators import Aggregator, folded

Columns = dict[str, Column]


class Stream:
    """Lazy; every method returns a new stream. `time` names the event-time column, which operators preserve."""

    def __init__(self, df: DataFrame, time: str = "_t", keys: tuple[str, ...] = ()):
        self.df, self.time, self.keys = df, time, tuple(keys)

    def _with(self, df: DataFrame, **changes) -> "Stream":
        return type(self)(df, changes.get("time", self.time), changes.get("keys", self.keys))

    def _carried(self, *made: str) -> list[Column]:
        return [F.col(c) for c in (*self.keys, self.time) if c in self.df.columns and c not in made]

    # stateless
    def map(self, **columns: Column) -> "Stream":
        """Projects to the given columns; time and keys stay."""
        return self._with(self.df.select(*self._carried(*columns), *[c.alias(n) for n, c in columns.items()]))

    def filter(self, predicate: Column) -> "Stream":
        return self._with(self.df.where(predicate))

    def filter_map(self, predicate: Column, **columns: Column) -> "Stream":
        return self.filter(predicate).map(**columns)

    def flat_map(self, name: str, elements: Column, **columns: Column) -> "Stream":
        """A row for each element of the array, at the row's time."""
        return self._with(self.df.select(*self._carried(name, *columns), *[c.alias(n) for n, c in columns.items()], F.explode(elements).alias(name)))

    def flatten(self, column: str) -> "Stream":
        return self._with(self.df.withColumn(column, F.explode(column)))

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> "Stream":
        return self._with(self.df.transform(f))

    def fork(self) -> tuple["Stream", "Stream"]:
        return self, self._with(self.df)

    def split(self, predicate: Column) -> tuple["Stream", "Stream"]:
        """(rows for which it is true, the others, unknown ones too)."""
        yes = F.coalesce(predicate, F.lit(False))
        return self.filter(yes), self.filter(~yes)

    def merge(self, *others: "Stream") -> "Stream":
        """Bag union; of several watermarks the least counts."""
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return self._with(out)

    union = merge

    # keys
    def keyby(self, **keys: Column) -> "Stream":
        """Declares key columns; nothing is shuffled until an operator needs it."""
        df = self.df
        for n, c in keys.items():
            df = df.withColumn(n, c)
        return self._with(df, keys=tuple(keys))

    def unkey(self) -> "Stream":
        return self._with(self.df.drop(*self.keys), keys=())

    # stateful
    def window(self, assigner: windows.Assigner, tiebreak: list[str] = (), **results: tuple[Aggregator, Column]) -> "Stream":
        """One element a key and window, at the window's end."""
        out = windows.aggregate(self.df, assigner, results, list(self.keys), self.time, tiebreak)
        return self._with(out, time="end" if "end" in out.columns else self.time)

    def scan(self, order: list[str], **results: tuple[Aggregator, Column]) -> "Stream":
        """Running aggregates over all elements up to each, in the order of time and `order`."""
        w = Window.partitionBy(*self.keys).orderBy(self.time, *order).rowsBetween(Window.unboundedPreceding, 0)
        df = self.df
        for n, (a, v) in results.items():
            df = df.withColumn(n, a.over(v, None).over(w))
        return self._with(df)

    def aggregate(self, **results: tuple[Aggregator, Column]) -> DataFrame:
        t = F.col(self.time) if self.time in self.df.columns else None
        if t is not None and self.keys and not self.df.isStreaming and all(a.monoid for a, _ in results.values()):
            return folded(self.df, [F.col(k) for k in self.keys], results, t)
        made = [a.over(v, t).alias(n) for n, (a, v) in results.items()]
        return self.df.groupBy(*self.keys).agg(*made) if self.keys else self.df.agg(*made)

    def group(self, name: str = "values", value: Column | None = None) -> DataFrame:
        """Each key with its elements by time."""
        v = F.struct("*") if value is None else value
        ordered = F.array_sort(F.collect_list(F.struct(F.col(self.time).alias("t"), v.alias("v"))))
        return self.df.groupBy(*self.keys).agg(F.transform(ordered, lambda x: x["v"]).alias(name))

    def dedup(self, columns: list[str], within: str | None = None) -> "Stream":
        if self.df.isStreaming:
            marked = self.df.withWatermark(self.time, within) if within else self.df
            return self._with(marked.dropDuplicatesWithinWatermark(columns) if within else marked.dropDuplicates(columns))
        return self._with(self.df.dropDuplicates(columns))

    # joins
    def window_join(self, other: "Stream", length: str, distinct: bool = False, **options) -> "Stream":
        f = joins.window_join_distinct if distinct else joins.window_join
        out = f(self.df, other.df, list(self.keys), list(other.keys), length, self.time, other.time, **options)
        return type(self)(out, "start", ())

    def join(self, index: DataFrame, on) -> "Stream":
        """With a static index of one row a key; unmatched elements go."""
        return self._with(joins.index_join(self.df, index, on))

    # order
    def order(self, *by: str | Column) -> DataFrame:
        return self.df.orderBy(*by)

    def head(self, n: int, *by: str | Column) -> DataFrame:
        return self.df.orderBy(*by).limit(n)

    take = head

    def tail(self, n: int, *by: str) -> DataFrame:
        """The last n by the columns, in their order."""
        return self.df.orderBy(*[F.desc(c) for c in by]).limit(n).orderBy(*by)


def custom_sort(values: Column, comparator: Callable[[Column, Column], Column]) -> Column:
    """An array sorted by a comparator of two elements (negative, zero, positive)."""
    return F.array_sort(values, comparator)
