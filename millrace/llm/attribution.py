"""Token counts of fields or sections from one encoding of the whole document.

A document is the concatenation of its fields. It is encoded once, so that a count is of tokens that training will see,
not of those that a section alone would have. The tokens' spans follow from the lengths of their bytes; they are joined
to the sections by intervals (both sides are ordered, so the join is one pass), and a token that crosses a boundary is
allocated by the rule:

    first     to the section that holds its first byte
    majority  to the section that holds most of its bytes, the earlier of equals
    split     to each section in proportion to the bytes there (counts are fractions then)

Spans are in code points, ends exclusive. Sections end after each match of `boundary`; the pieces cover the document.

Defined cases: a null field is empty and has no section; a document of empty fields has no row; null ids are kept;
repeated rows are counted one by one; very long documents are encoded in parts and counted whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

OUT = "doc_id long, field string, section int, start long, end long, n_tokens double, n_crossing long"


def allocate(token_ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, boundary-crossing tokens that touch it); cuts: 0, the sections' ends in bytes."""
    n = len(cuts) - 1
    begins = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    a = np.searchsorted(cuts, begins, "right") - 1
    b = np.searchsorted(cuts, token_ends, "left") - 1
    across = np.flatnonzero(a != b)
    home, share = a.copy(), np.zeros(n)
    crossing = np.zeros(n, np.int64)
    for t in across.tolist():
        parts = np.minimum(cuts[a[t] + 1 : b[t] + 2], token_ends[t]) - np.maximum(cuts[a[t] : b[t] + 1], begins[t])
        crossing[a[t] : b[t] + 1] += 1
        if rule == "majority":
            home[t] = a[t] + int(np.argmax(parts))
        elif rule == "split":
            share[a[t] : b[t] + 1] += parts / parts.sum()
    if rule == "split":
        home = np.delete(home, across)
    return np.bincount(home, minlength=n)[:n] + share, crossing


def attribute(docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), boundary: str = "\n", rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """A row for each section that is not empty: doc_id, field, section (from 0 in its document), start, end, n_tokens, n_crossing."""
    if rule not in ("first", "majority", "split"):
        raise ValueError(rule)
    cut = re.compile(boundary.encode())
    names = [f"_f{i}" for i in range(len(fields))]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(n) for f, n in zip(fields, names)])
    source = source.withColumn("text", F.concat(*names)).select("doc_id", "text", *[F.octet_length(n).alias(n) for n in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                cols = {k: [] for k in ("doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing")}
                sizes = list(zip(*(batch.column(n).to_pylist() for n in names)))
                for doc, text, raw, size in zip(batch.column("doc_id").to_pylist(), batch.column("text"), enc.encode(batch.column("text")), sizes):
                    data = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                    if not data:
                        continue
                    at = np.cumsum(size)
                    cuts = np.unique(np.concatenate([[0, len(data)], at, np.fromiter((m.end() for m in cut.finditer(data)), np.int64)]).astype(np.int64))
                    ends = np.cumsum(enc.lengths[np.frombuffer(raw, enc.dtype)], dtype=np.int64)
                    tokens, crossing = allocate(ends, cuts, rule)
                    lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[cuts]
                    n = len(cuts) - 1
                    cols["doc_id"] += [doc] * n
                    cols["field"] += [fields[j] for j in np.searchsorted(at, cuts[:-1], "right").tolist()]
                    cols["section"] += range(n)
                    cols["start"] += lead[:-1].tolist()
                    cols["end"] += lead[1:].tolist()
                    cols["n_tokens"] += tokens.tolist()
                    cols["n_crossing"] += crossing.tolist()
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], list(cols))

    return source.mapInArrow(count, OUT)
