"""Aggregators: monoids by lift, combine and lower, and holistic ones over a group ordered by event time.

`count`, `total`, `average`, `minimum`, `maximum` and `median` are built-in functions of Spark, with partial
aggregation before the shuffle. A custom monoid given as column functions folds the group's values in event-time order,
part by part (`folded`): the parts of a group are folded by themselves wherever they are and their states then combined, so
that no task holds a group's values. One that only Python can compute uses a grouped-aggregate Pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds of event time whose values are folded together before states are combined.
PART_US = 60 * 1_000_000


@dataclass(frozen=True)
class Aggregator:
    """`over(value, time)` is an aggregate column; `kind` says whether partial results combine."""

    kind: str
    over: Callable[[Column, Column | None], Column]
    name: str = "value"
    #: (lift, combine, lower) of a custom monoid.
    monoid: tuple[Callable, Callable, Callable] | None = None


def _ordered(value: Column, time: Column | None) -> Column:
    """The group's values by time; equal times by value."""
    if time is None:
        return F.collect_list(value)
    return F.transform(F.array_sort(F.collect_list(F.struct(time.alias("t"), value.alias("v")))), lambda x: x["v"])


def builtin(name: str, f: Callable[[Column], Column]) -> Aggregator:
    return Aggregator("incremental", lambda v, _t: f(v), name)


count = builtin("count", lambda v: F.count(F.lit(1)))
total = builtin("sum", F.sum)
average = builtin("average", F.avg)
minimum = builtin("min", F.min)
maximum = builtin("max", F.max)
median = Aggregator("holistic", lambda v, _t: F.median(v), "median")
NAMED = {"count": count, "sum": total, "average": average, "min": minimum, "max": maximum, "median": median}


def _fold(states: Column, combine: Callable[[Column, Column], Column]) -> Column:
    rest = F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(states, 1), combine)


def incremental(lift: Callable[[Column], Column], combine: Callable[[Column, Column], Column], lower: Callable[[Column], Column] = lambda s: s, name: str = "value") -> Aggregator:
    """lower(fold(combine, map(lift))), the values in event-time order; needs no identity. Null over no values.

    Null values are left out. `combine` must be associative. As a column by itself (`over`) it folds the group's list; `folded` bounds that."""

    def over(v: Column, t: Column | None) -> Column:
        lifted = F.transform(F.filter(_ordered(v, t), lambda x: x.isNotNull()), lift)
        return F.when(F.size(lifted) > 0, lower(_fold(lifted, combine)))

    return Aggregator("incremental", over, name, (lift, combine, lower))


def _part(values: Column, a: Aggregator) -> Column:
    """The state of a part's values, each in a struct."""
    lift, combine, _ = a.monoid
    kept = F.filter(values, lambda x: x["v"].isNotNull())
    return F.when(F.size(kept) > 0, _fold(F.transform(kept, lambda x: lift(x["v"])), combine))


def folded(df: DataFrame, keys: list, aggregators: dict[str, tuple[Aggregator, Column]], time: Column, part_us: int = PART_US) -> DataFrame:
    """Custom monoids by key in two steps: within each `part_us` of event time, then over the parts' states in order.

    A group's task then holds a state for each part and not its values; parts are folded beside each other."""
    us = F.unix_micros(time.cast("timestamp"))
    names = [f"_s{i}" for i in range(len(aggregators))]
    cut = df.select(*keys, F.coalesce(F.floor(us / part_us), F.lit(-(1 << 62))).alias("_part"), time.alias("_at"), *[F.struct(v.alias("v")).alias(n) for n, (_, v) in zip(names, aggregators.values())])
    by = cut.columns[: len(keys)]
    partial = []
    for n, (a, _) in zip(names, aggregators.values()):
        partial.append(_part(_ordered(F.col(n), F.col("_at")), a).alias(n))
    states = cut.groupBy(*by, "_part").agg(*partial)
    made = []
    for n, (name, (a, _)) in zip(names, aggregators.items()):
        _, combine, lower = a.monoid
        held = F.collect_list(F.when(F.col(n).isNotNull(), F.struct("_part", F.col(n).alias("s"))))
        held = F.transform(F.array_sort(held, lambda a, b: F.when(a["_part"] < b["_part"], -1).otherwise(1)), lambda x: x["s"])
        made.append(F.when(F.size(held) > 0, lower(_fold(held, combine))).alias(name))
    return states.groupBy(*by).agg(*made)


def holistic(compute: Callable[[Column], Column], name: str = "value") -> Aggregator:
    """compute(array of the group's values in event-time order)."""
    return Aggregator("holistic", lambda v, t: compute(_ordered(v, t)), name)


def python(compute: Callable, returns: str, name: str = "value") -> Aggregator:
    """compute(pandas.Series) -> scalar, for what columns cannot express."""
    udf = F.pandas_udf(compute, returns, F.PandasUDFType.GROUPED_AGG)
    return Aggregator("holistic", lambda v, _t: udf(v), name)
