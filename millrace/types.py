"""The language's types as Spark types, and columns of its option, result, tuple and variant values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unsigned integers take the next wider signed type; 128 bits are limited to 38 decimal digits.
TYPES = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "usize": T.LongType(),
    "i128": T.DecimalType(38, 0), "u128": T.DecimalType(38, 0), "f32": T.FloatType(), "f64": T.DoubleType(),
    "char": T.StringType(), "String": T.StringType(), "Blob": T.BinaryType(), "Time": T.TimestampType(),
    "Duration": T.DayTimeIntervalType(), "Path": T.StringType(), "Url": T.StringType(), "SocketAddr": T.StringType(),
    "File": T.StringType(), "unit": T.NullType(),
}
_RANGES = {"u8": 1 << 8, "u16": 1 << 16, "u32": 1 << 32, "u64": 1 << 64}


def option(t: T.DataType) -> T.DataType:
    return t  # a nullable column


def result(t: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("ok", t), T.StructField("error", T.StringType())])


def tuple_of(*ts: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f"_{i}", t) for i, t in enumerate(ts)])


def variant(**cases: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("tag", T.StringType(), False), *[T.StructField(k, t) for k, t in cases.items()]])


def matrix(t: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(t))])


def checked(c: Column, name: str) -> Column:
    """The column as the named type; an unsigned value out of range is an error."""
    made = c.cast(TYPES[name])
    if name not in _RANGES:
        return made
    wide = c.cast("decimal(38,0)")
    return F.when(c.isNull() | ((wide >= 0) & (wide < F.lit(str(_RANGES[name])).cast("decimal(38,0)"))), made).otherwise(F.raise_error(F.lit(f"out of range for {name}")))


def some(c: Column) -> Column:
    return c


def none(t: str) -> Column:
    return F.lit(None).cast(t)


def unwrap(c: Column, message: str = "unwrap of none") -> Column:
    return F.coalesce(c, F.raise_error(F.lit(message)))


def ok(c: Column) -> Column:
    return F.struct(c.alias("ok"), F.lit(None).cast("string").alias("error"))


def error(message: Column, t: str) -> Column:
    return F.struct(F.lit(None).cast(t).alias("ok"), message.alias("error"))


def is_ok(r: Column) -> Column:
    return r["error"].isNull()


def is_error(r: Column) -> Column:
    return r["error"].isNotNull()


def unwrap_ok(r: Column) -> Column:
    return F.when(is_ok(r), r["ok"]).otherwise(F.raise_error(r["error"]))


def unwrap_error(r: Column) -> Column:
    return F.when(is_error(r), r["error"]).otherwise(F.raise_error(F.lit("unwrap_error of ok")))


def map_ok(r: Column, f) -> Column:
    return F.struct(F.when(is_ok(r), f(r["ok"])).alias("ok"), r["error"].alias("error"))


def pack(*cs: Column) -> Column:
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cs)])
