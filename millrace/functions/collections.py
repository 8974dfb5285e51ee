"""Arrays, vectors, dictionaries, sets and iterators as array and map columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# vectors and arrays, from 0
def get(v: Column, i: Column | int) -> Column:
    """Null beyond the ends."""
    return F.get(v, F.lit(i) if isinstance(i, int) else i)


def set_at(v: Column, i: Column, x: Column) -> Column:
    return F.transform(v, lambda e, j: F.when(j == i, x).otherwise(e))


def push(v: Column, x: Column) -> Column:
    return F.array_append(v, x)


def pop(v: Column) -> Column:
    """(all but the last, the last or null)."""
    return F.struct(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))).alias("_0"), F.try_element_at(v, F.lit(-1)).alias("_1"))


def insert(v: Column, i: Column, x: Column) -> Column:
    return F.concat(F.slice(v, F.lit(1), i), F.array(x), F.slice(v, i + 1, F.greatest(F.size(v) - i, F.lit(0))))


def remove(v: Column, i: Column) -> Column:
    """(the rest, the element)."""
    return F.struct(F.concat(F.slice(v, F.lit(1), i), F.slice(v, i + 2, F.greatest(F.size(v) - i - 1, F.lit(0)))).alias("_0"), F.get(v, i).alias("_1"))


def truncate(v: Column, n: int | Column) -> Column:
    return F.slice(v, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def length(v: Column) -> Column:
    return F.size(v)


def is_empty(v: Column) -> Column:
    return F.size(v) == 0


def sort(v: Column) -> Column:
    return F.array_sort(v)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def into_set(v: Column) -> Column:
    return F.array_distinct(v)


def into_dict(v: Column) -> Column:
    """Pairs to a map; the last value of a key counts (spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_from_entries(v)


# dictionaries
def dict_insert(d: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(d, lambda x, _: x != k), F.create_map(k, v))


def dict_remove(d: Column, k: Column) -> Column:
    return F.map_filter(d, lambda x, _: x != k)


def dict_get(d: Column, k: Column) -> Column:
    return F.try_element_at(d, k)


def dict_contains(d: Column, k: Column) -> Column:
    return F.map_contains_key(d, k) if not isinstance(k, Column) else F.array_contains(F.map_keys(d), k)


# sets
def set_insert(s: Column, x: Column) -> Column:
    return F.array_union(s, F.array(x))


def set_remove(s: Column, x: Column) -> Column:
    return F.array_remove(s, x)


def set_contains(s: Column, x: Column) -> Column:
    return F.array_contains(s, x)


# iterators
def enumerate_(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.struct(i.cast("long").alias("_0"), x.alias("_1")))


def map_(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(v, f)


def filter_(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(v, f)


def fold(v: Column, init: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(v, init, f)


# matrices: struct<shape: array<int>, data: array<T>> in row-major order
def matrix(shape: list[int], data: Column) -> Column:
    return F.struct(F.array(*[F.lit(n) for n in shape]).alias("shape"), data.alias("data"))


def zeros(shape: list[int], kind: str = "double") -> Column:
    n = 1
    for s in shape:
        n *= s
    return matrix(shape, F.array_repeat(F.lit(0).cast(kind), n))


def insert_axis(m: Column, axis: int) -> Column:
    return F.struct(F.concat(F.slice(m["shape"], 1, axis), F.array(F.lit(1)), F.slice(m["shape"], F.lit(axis + 1), F.greatest(F.size(m["shape"]) - axis, F.lit(0)))).alias("shape"), m["data"].alias("data"))


def remove_axis(m: Column, axis: int) -> Column:
    """An axis of length 1 goes; another is an error."""
    shape = m["shape"]
    rest = F.concat(F.slice(shape, 1, axis), F.slice(shape, F.lit(axis + 2), F.greatest(F.size(shape) - axis - 1, F.lit(0))))
    return F.struct(F.when(F.get(shape, F.lit(axis)) == 1, rest).otherwise(F.raise_error(F.lit("axis is not 1"))).alias("shape"), m["data"].alias("data"))


def into_vec(m: Column) -> Column:
    return m["data"]


def transpose(m: Column) -> Column:
    """Of two dimensions."""
    r, c = m["shape"][0], m["shape"][1]
    data = F.when(r * c == 0, m["data"]).otherwise(F.transform(F.sequence(F.lit(0), r * c - 1), lambda i: F.get(m["data"], (i % r * c + F.floor(i / r)).cast("int"))))
    return F.struct(F.array(c, r).alias("shape"), data.alias("data"))


def at(m: Column, *index: int) -> Column:
    """The element at an index of any number of dimensions."""
    place = F.lit(0)
    for d, i in enumerate(index):
        place = place * F.get(m["shape"], F.lit(d)) + i
    return F.get(m["data"], place)
