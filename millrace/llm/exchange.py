"""Which grams occur more than once in a corpus, asked and answered in packed rows.

Grams are asked for by one row for each unit of documents, of UNIT grams or a task's, and shard of the hash space: sorted
hashes and their documents as bytes, so that a shuffle carries little more than the hashes. What repeats within a unit is
known to repeat at once, is asked once for all the unit's documents, and so costs the same however common it is.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, by_shard, chunks, shards, stored, text_digest
from .windows import mix

ASK = "shard int, hashes binary, owners binary, known_hashes binary, known_owners binary"
#: Grams that a task asks for together: some ten MB of text.
UNIT = 1 << 19
#: Times a gram is asked for (once by a unit of documents, twice if it repeats there) from which on it is hot.
HOT = 32
#: Head of a packed row: entries, bytes before compression.
HEAD = struct.Struct("<IQ")


def squeeze(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of one length and further bytes, compressed. Eight-byte integers go as differences, which are small where
    they mostly ascend; the bytes of a column are laid out by their weight."""
    n, parts = len(columns[0]), []
    for c in columns:
        c = np.diff(c, prepend=c.dtype.type(0)) if c.dtype.kind == "i" and c.itemsize == 8 else np.ascontiguousarray(c)
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, c.itemsize).T).tobytes())
    raw = b"".join([*parts, tail])
    return HEAD.pack(n, len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def expand(packed: pa.Buffer, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    """What `squeeze` was given, the columns being of these types."""
    n, size = HEAD.unpack_from(packed)
    raw = pa.decompress(packed.slice(HEAD.size), size, "zstd", asbytes=True)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind)[:, 0]
        out.append(np.cumsum(c) if kind.kind == "i" and kind.itemsize == 8 else c)
        at += n * kind.itemsize
    return out, raw[at:]


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Even shards of hashes that need not be even themselves: minimizers are small."""
    hashes = mix(hashes, 41)
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def dealt(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by shard, where each shard starts)."""
    shard = shard_of(h, n)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def repeated(docs: DataFrame, grams: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], within: bool, hot: int = HOT) -> DataFrame:
    """(doc_id, h, hot): the grams of each document that repeat, and whether more than `hot` asked for it. `grams` gives
    (document's place, hash) of a chunk.

    A gram repeats if two documents have it, or if `within` and one has it twice."""
    n = shards(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for c in chunks(batches):
            doc, h = grams(c)
            held.append((c.ids()[doc], h))
            size += len(h)
            if size >= UNIT:
                yield from packed(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            yield from packed(*(np.concatenate(x) for x in zip(*held)))

    def packed(owner: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((owner, h))
        owner, h = owner[order], h[order]
        same, other = np.zeros(len(h), bool), np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        other[1:] = owner[1:] != owner[:-1]
        group = np.cumsum(~same) - 1
        known = np.zeros(group[-1] + 1 if len(group) else 0, bool)
        known[group[same & (other | within)]] = True
        local = known[group]
        send = np.flatnonzero(~same)  # one document stands for all, marked if the repeat is known already
        place, cuts = dealt(h[send], n)
        send = send[place]
        tell = np.flatnonzero((~same | other) & local)
        place, at_known = dealt(h[tell], n)
        tell = tell[place]
        flag, hs, os, kh, ko = local[send], h[send], owner[send], h[tell], owner[tell]
        rows = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, d, e = cuts[s], cuts[s + 1], at_known[s], at_known[s + 1]
            again = flag[a:b]  # a known repeat asks twice
            rows.append((s, hs[a:b].tobytes() + hs[a:b][again].tobytes(), os[a:b].tobytes() + os[a:b][again].tobytes(), kh[d:e].tobytes(), ko[d:e].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["shard", "hashes", "owners", "known_hashes", "known_owners"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        h, o, kh, ko = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint64 if "hash" in c else np.int64) for b in held for x in b.column(c)]) for c in ("hashes", "owners", "known_hashes", "known_owners"))
        order = np.argsort(h, kind="stable")
        s = h[order]
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
        asks = np.diff(cuts)
        hit = order[np.repeat(asks > 1, asks)]
        many = np.append(s[cuts[:-1][asks > hot]], ~np.uint64(0))
        h, o = np.concatenate([h[hit], kh]), np.concatenate([o[hit], ko])
        once = np.lexsort((o, h))
        h, o = h[once], o[once]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[new], o[new]
        for i in range(0, len(h), 1 << 16):
            part = h[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(o[i : i + (1 << 16)]), pa.array(part.view(np.int64)), pa.array(many[np.searchsorted(many, part)] == part)], ["doc_id", "h", "hot"])

    return by_shard(docs.mapInArrow(ask, ASK), n).mapInArrow(answer, "doc_id long, h long, hot boolean")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the documents whose whole text is that of a document with a smaller id."""
    seen = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    groups = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "copied-texts")
    return seen.join(groups, "digest").where("doc_id > least").select("doc_id", "digest")


def noted(docs: DataFrame, grams: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], within: bool, hot: int = HOT) -> DataFrame:
    """doc_id, text, hs (repeated grams or null), hot (the hot ones of them) and copied (whether the whole text is a copy
    of an earlier one).

    Null ids must have been replaced. The texts are dealt out once, by id."""
    nothing = F.lit(None).cast("binary").alias("digest")
    a = repeated(docs, grams, within, hot).select("doc_id", "h", F.when(F.col("hot"), F.col("h")).alias("hot"), nothing)
    b = copies(docs).select("doc_id", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("hot"), "digest")
    notes = stored(a.unionByName(b).groupBy("doc_id").agg(F.collect_list("h").alias("hs"), F.collect_list("hot").alias("hot"), F.collect_set("digest").alias("digests")), "notes").withColumnRenamed("doc_id", "_id")
    joined = docs.join(notes.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    return joined.select("doc_id", "text", "hs", "hot", F.coalesce(F.array_contains("digests", text_digest(F.col("text"))), F.lit(False)).alias("copied"))
