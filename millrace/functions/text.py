"""String functions. Positions count code points from 0; `byte_len` counts bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new() -> Column:
    return F.lit("")


def push_char(s: Column, c: Column) -> Column:
    return F.concat(s, c)


push_string = push_char


def remove(s: Column, i: Column) -> Column:
    """(rest, character at i)."""
    return F.struct(F.concat(F.substr(s, F.lit(1), i), F.substr(s, i + 2)).alias("_0"), F.substr(s, i + 1, F.lit(1)).alias("_1"))


def insert_char(s: Column, i: Column, c: Column) -> Column:
    return F.overlay(s, c, i + 1, F.lit(0))


def is_empty(s: Column) -> Column:
    return s == ""


def length(s: Column) -> Column:
    return F.length(s)


def byte_len(s: Column) -> Column:
    return F.octet_length(s)


def split_off(s: Column, i: Column) -> Column:
    """(head, tail)."""
    return F.struct(F.substr(s, F.lit(1), i).alias("_0"), F.substr(s, i + 1).alias("_1"))


def clear(s: Column) -> Column:
    return F.when(s.isNotNull(), F.lit(""))


def lines(s: Column) -> Column:
    """Lines without their ends; a final line feed starts no further line, and no text has no line."""
    parts = F.split(s, "\r?\n", -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(trimmed)


def split(s: Column, sep: str) -> Column:
    """By a literal separator, empty parts kept."""
    import re

    return F.split(s, re.escape(sep) if sep else sep, -1)


def concat(*parts: Column | str) -> Column:
    """Interpolation: literals and values as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def encode_json(x: Column) -> Column:
    return F.to_json(x)


def decode_json(s: Column, schema: str) -> Column:
    return F.from_json(s, schema)


def encode_csv(x: Column, sep: str = ",") -> Column:
    return F.to_csv(x, {"sep": sep})


def decode_csv(s: Column, schema: str, sep: str = ",") -> Column:
    return F.from_csv(s, schema, {"sep": sep})


def path_join(a: Column, b: Column) -> Column:
    """b alone if it is absolute."""
    return F.when(F.startswith(b, F.lit("/")), b).otherwise(F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), b))


def url_parse(s: Column) -> Column:
    part = lambda p: F.try_parse_url(s, F.lit(p))
    return F.struct(part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("fragment"))
