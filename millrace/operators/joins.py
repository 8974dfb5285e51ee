"""Joins: within event-time windows, against a static index, on any predicate, and lateral.

A window join equates the keys and the window that each side's time falls in, so it is one hash or sort-merge join
with one shuffle for each side. On streams each side keeps only its window as event time: with a second event-time
column Spark refuses the plan, and with a plain number in the window's place state would never be dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated bytes up to which an index is sent to every executor.
BROADCAST_BYTES = 64 << 20


def _windowed(df: DataFrame, keys: list[str], time: str, length: str, prefix: str) -> DataFrame:
    payload = [F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != time or not df.isStreaming]
    return df.select(F.window(F.col(time), length).alias("_w"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *payload)


def window_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], length: str, left_time: str = "_t", right_time: str = "_t", prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Inner equi-join of rows in the same tumbling window. Columns: `start`, `end`, then each side's, prefixed; the
    joined element's time is the window's start."""
    if len(left_keys) != len(right_keys):
        raise ValueError("as many keys on either side")
    a, b = _windowed(left, left_keys, left_time, length, prefixes[0]), _windowed(right, right_keys, right_time, length, prefixes[1])
    on = [f"_k{i}" for i in range(len(left_keys))] + ["_w"]
    out = a.join(b, on)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c not in on])


def window_join_distinct(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], length: str, left_time: str = "_t", right_time: str = "_t", prefixes: tuple[str, str] = ("l_", "r_"), tiebreak: tuple[list[str], list[str]] = ((), ()), strict: bool = False) -> DataFrame:
    """As window_join with at most one row for each side, key and window: the first by time (and tiebreak).

    `strict` raises an error on a second row. On streams the first to arrive counts."""

    def one(df: DataFrame, keys: list[str], time: str, ties: list[str]) -> DataFrame:
        w = F.window(F.col(time), length)
        if df.isStreaming:
            return df.withColumn("_d", w).dropDuplicates([*keys, "_d"]).drop("_d")
        least = F.min_by(F.struct(*df.columns), F.struct(F.col(time), *[F.col(t) for t in ties]))
        grouped = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], w.alias("_d")).agg(least.alias("_s"), F.count(F.lit(1)).alias("_n"))
        if strict:
            grouped = grouped.withColumn("_s", F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.raise_error(F.lit("two rows of one key in a window"))))
        return grouped.select("_s.*")

    return window_join(one(left, left_keys, left_time, list(tiebreak[0])), one(right, right_keys, right_time, list(tiebreak[1])), left_keys, right_keys, length, left_time, right_time, prefixes)


def size_estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def index_join(df: DataFrame, index: DataFrame, on: Column | str | list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of a table or stream with a static index of one row a key; sent to the executors if it is small."""
    return df.join(F.broadcast(index) if size_estimate(index) <= broadcast_bytes else index, on)


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Join on any predicate; equalities in it still make a hash or sort-merge join."""
    return left.join(right, on)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Independent generators."""
    return left.crossJoin(right)


def lateral(df: DataFrame, name: str, generator: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """A generator that depends on the row: one output row for each element of the array."""
    return df.withColumn(name, F.explode(generator(df) if callable(generator) else generator))


def equi_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Equi-join on two lists of columns; the right keys are dropped."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in right_on})
    cond = [left[a] == r[f"_r_{b}"] for a, b in zip(left_on, right_on, strict=True)]
    return left.join(r, cond).drop(*[f"_r_{c}" for c in right_on])
