"""Substring dedup by merging Burrows-Wheeler transforms.

1. A byte string of WINDOW bytes is known by its minimizer, a gram of GRAM bytes; grams that several documents have are
   found by an exchange of hashes (`exchange.repeated`). Around each such gram a document's context, the bytes of all
   windows with that minimizer, goes to the gram's shard, once for equal contexts of a chunk (`contexts`). Contexts
   outside shared grams hold no window that another document has.
2. In a shard equal contexts are one string with its least document. Strings that share a gram and half of what a
   window has besides it with another string go into blocks; each block's suffixes are sorted and give its transform.
3. The blocks' transforms are merged by refining their interleave (Holt and McMillan): a round orders all rows by one
   symbol more with one stable distribution of the transforms' symbols, and a boundary that appears in round k says
   that the common prefix there has k - 1 symbols. After WINDOW rounds the intervals between boundaries are the
   repeated strings; no suffix of the whole is sorted again. Each interval's least document decides which of its
   occurrences are removed.

Transforms are merged within shards of bounded size, not over the whole corpus, whose single transform no task could
hold; equal windows always meet in one shard.

Whole copies of earlier texts are known by their digest and are not taken apart.

Hashes only say where to look: whole copies are known by SHA-256, contexts are compared byte by byte, and the transforms
find equal windows symbol by symbol.

Defined cases: a null text is empty; a null id is the smallest; repeated rows of one id are one document: what is
removed from one is removed at that place from each, and of different texts with one id neither is the earlier one, so
windows of one stay in the other; texts shorter than a window stay whole, very long texts are taken whole, a chunk by
themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Chunk, chunks, shards, stored, texts
from .contexts import cut_runs, flags, judged, starts_and_counts, with_runs
from .exchange import HOT, expand, noted, shard_of, squeeze

WINDOW, GRAM = 50, 16
NULL_ID = np.iinfo(np.int64).min
#: Bytes of strings in a block, and in one merge, whose arrays then fit a core's cache; strings of one gram in a shard are never parted.
BLOCK_BYTES, MERGE_BYTES = 1 << 15, 1 << 17
CONTEXTS = "doc_id long, text binary, n_bytes long, kept_sha256 string, n_removed long, n_spans long, own binary, shard int, packed binary"
ASKS = ("shard", "packed")
#: Columns of a packed row: owner, place, offset of the gram and size of each context.
COLUMNS = ("<i8", "<i8", "<i4", "<i4")


def transform(strings: Sequence[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, suffix, string): of the rows in order of their first `depth` symbols the symbol before, the place in
    the string and the string. Symbols are bytes plus 1; 0 ends a string, and ends are ordered as the strings."""
    sizes = np.array([len(s) for s in strings])
    m, n = len(strings), int(sizes.sum()) + len(strings)
    text = np.zeros(n, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = np.ones(n, bool)
    inside[starts[1:] - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    # Six symbols make the first key, whose last ten bits and more tell the ends apart that come so soon.
    key, ended = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    end_of = np.repeat(np.arange(m), sizes + 1)
    for k in range(6):
        s = np.zeros(n, np.int64)
        s[: max(0, n - k)] = text[k:]
        key = key << 9 | np.where(ended >= 0, 0, s)
        ended = np.where((ended < 0) & (s == 0), end_of, ended)
    order = np.lexsort((ended, key)) if m > 1 else np.argsort(key, kind="stable")
    rank, step = _ranks(order, key, ended), 6
    while step < depth:
        key = rank * (int(rank.max()) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        rank = _ranks(order, key)
        step *= 2
    order = np.argsort(rank, kind="stable")
    string = np.repeat(np.arange(m), sizes + 1)[order]
    before = np.where(order == starts[:-1][string], 0, text[order - 1])
    return before.astype(np.uint16), order - starts[:-1][string], string


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def merge(transforms: Sequence[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval): rows of the transforms, numbered one transform after the other, whose first `depth` symbols
    other rows have too, in merged order, and the number of each one's interval.

    A round distributes the rows by the symbol before them, stably, which turns the order by k symbols into the order
    by k + 1 of the rows that those symbols lead to. A row whose first k symbols no other row has leads to such a row
    again, so it is left out from then on; ends of strings differ from each other and lead nowhere."""
    last = np.concatenate(transforms)
    base = np.cumsum([0, *map(len, transforms)])
    # To which row of its transform each row leads: a transform's rows are distributed by symbol as all are.
    lead = np.concatenate([_inverse(t) + o for t, o in zip(transforms, base)])
    row = np.arange(len(last))
    interval = np.zeros(len(last), np.int32)
    for _ in range(depth):
        symbol = last[row]
        order = np.argsort(symbol, kind="stable")
        order = order[np.searchsorted(symbol[order], 1) :]
        symbol, interval, row = symbol[order], interval[order], lead[row[order]]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(new[:-1] & new[1:])
        row, interval = row[shared], np.cumsum(new[:-1], dtype=np.int32)[shared]
    return row, interval


def _inverse(transform: np.ndarray) -> np.ndarray:
    out = np.empty(len(transform), np.int64)
    out[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    return out


def least_owners(strings: Sequence[bytes], owners: np.ndarray, window: int, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(least, base): for the window at place p of string i, least[base[i] + p], the least owner of a string with it."""
    blocks, size = [[]], 0
    for i, s in enumerate(strings):
        if size + len(s) > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(i)
        size += len(s)
    made = [transform([strings[i] for i in b], window) for b in blocks]
    row, interval = merge([t for t, _, _ in made], window)
    where = np.concatenate([np.array(b)[string] for b, (_, _, string) in zip(blocks, made)])[row]
    place = np.concatenate([suffix for _, suffix, _ in made])[row]
    sizes = np.maximum(0, np.array([len(s) for s in strings]) - window + 1)
    base = np.concatenate([[0], np.cumsum(sizes)])
    least = np.repeat(owners, sizes)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        own = np.repeat(np.minimum.reduceat(owners[where], first), np.diff(np.append(first, len(where))))
        least[base[where] + place] = own
    return least, base


class Anchors:
    """Gram hashes and minimizers of a chunk's bytes."""

    def __init__(self, c: Chunk, window: int, gram: int):
        self.sums = W.prefix(W.BYTES[c.data])
        self.grams = W.mix(W.grams(self.sums, gram), 31)
        n = max(0, len(c.data) - window + 1)
        self.minimizer = W.minimizers(self.grams, window - gram + 1)[:n]
        self.valid = np.zeros(n, bool)
        for a, b in zip(c.starts[:-1].tolist(), c.starts[1:].tolist()):
            self.valid[a : max(a, b - window + 1)] = True

    def places(self) -> np.ndarray:
        used = np.zeros(len(self.grams), bool)
        used[self.minimizer[self.valid]] = True
        return np.flatnonzero(used)


def _contexts(batches: Iterator[pa.RecordBatch], n_shards: int, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches, limit=1 << 20):
        x = Anchors(c, window, gram)
        ids, copied = c.ids(), np.array(c.column("copied").to_pylist(), bool)
        at = x.places()
        live = x.valid & flags(c, "hs", x.grams, at)[x.minimizer]
        for d in np.flatnonzero(copied).tolist():
            live[c.starts[d] : c.starts[d + 1]] = False
        s, e, key = cut_runs(live, x.minimizer, x.grams, x.sums, flags(c, "hot", x.grams, at), window, gram)
        doc = np.searchsorted(c.starts, s, "right") - 1
        owner, place, size = ids[doc], s - c.starts[doc], e - s + window - 1
        raw = c.data.tobytes()
        # The first context of each content, by id, stands for those of larger ids; a repeated row is not sent again.
        later, again, known = np.zeros(len(s), bool), np.zeros(len(s), bool), {}
        for i in np.lexsort((place, owner)).tolist():
            j = known.setdefault(raw[s[i] : s[i] + size[i]], i)
            later[i] = owner[j] != owner[i]
            again[i] = j != i and owner[j] == owner[i] and place[j] == place[i]
        del known
        pending = np.zeros(c.n, bool)
        pending[doc] = True
        cols = {name: [] for name in ("doc_id", "text", "n_bytes", "kept_sha256", "n_removed", "n_spans", "own", *ASKS)}
        own = np.searchsorted(doc, np.arange(c.n + 1)).tolist()
        for d in range(c.n):
            text = raw[c.starts[d] : c.starts[d + 1]]
            gone = bool(copied[d]) and len(text) >= window
            a, b = own[d : d + 2]
            mine = later[a:b]
            cols["doc_id"].append(int(ids[d]))
            cols["n_bytes"].append(len(text))
            cols["text"].append(text if pending[d] else None)
            cols["own"].append(np.stack([place[a:b][mine], (e - s)[a:b][mine]], 1).astype("<i8").tobytes() if pending[d] else None)
            cols["kept_sha256"].append(None if pending[d] else hashlib.sha256(b"" if gone else text).hexdigest())
            cols["n_removed"].append(None if pending[d] else len(text) * gone)
            cols["n_spans"].append(None if pending[d] else int(gone))
        shard = shard_of(key, n_shards)
        send = np.flatnonzero(~later & ~again)
        send = send[np.argsort(shard[send], kind="stable")]
        for part in np.split(send, np.flatnonzero(np.diff(shard[send])) + 1) if len(send) else ():
            cols["shard"].append(int(shard[part[0]]))
            text = b"".join([raw[i : i + n] for i, n in zip(s[part].tolist(), size[part].tolist())])
            cols["packed"].append(squeeze(owner[part], place[part], (x.minimizer[s[part]] - s[part]).astype("<i4"), size[part].astype("<i4"), tail=text))
        m = len(cols["shard"])
        kinds = {"kept_sha256": pa.string(), "shard": pa.int32()} | dict.fromkeys(("doc_id", "n_bytes", "n_removed", "n_spans"), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([None] * c.n + v if name in ASKS else v + [None] * m, kinds.get(name, pa.binary())) for name, v in cols.items()], list(cols))


def _overlapping(strings: list[bytes], offsets: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Flags of the strings that can share a window with another.

    A window has some bytes left of its gram and the others right of it. Of the cuts below, the one at or before that
    place and the next one bound both sides from below, so two strings with a common window have the same bytes there."""
    rest = window - gram
    cuts = [rest * k // 4 for k in range(5)]
    out = np.zeros(len(strings), bool)
    sides = [(a, rest - b) for a, b in zip(cuts, cuts[1:])]
    keys: list[dict[bytes, int]] = [{} for _ in sides]
    for i, (s, o) in enumerate(zip(strings, offsets.tolist())):
        right = len(s) - o - gram
        for seen, (a, b) in zip(keys, sides):
            if o >= a and right >= b:
                j = seen.setdefault(s[o - a : o + gram + b], i)
                if j != i:
                    out[i] = out[j] = True
    return out


def _judge(packed: list[pa.Buffer], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, count) of the removed windows in the contexts of a shard, a row for each run."""
    rows = [expand(p, *COLUMNS) for p in packed]
    owner, place, offset, size = (np.concatenate([r[0][k] for r in rows]) for k in range(4))
    raw = b"".join([r[1] for r in rows])
    del rows
    ends = np.cumsum(size, dtype=np.int64)
    known: dict[tuple[int, bytes], int] = {}
    which = np.fromiter((known.setdefault((o, raw[e - n : e]), len(known)) for o, e, n in zip(offset.tolist(), ends.tolist(), size.tolist())), np.int64, len(size))
    strings = [k[1] for k in known]
    at = np.array([k[0] for k in known], np.int64)
    gram_of = np.array([hash(t[o : o + gram]) for o, t in known], np.int64)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    windows = np.maximum(0, np.array([len(x) for x in strings]) - window + 1)
    base = np.concatenate([[0], np.cumsum(windows)])
    first = np.repeat(least, windows)
    # Strings that share a gram stay together; merges of about MERGE_BYTES.
    todo = np.flatnonzero(_overlapping(strings, at, window, gram))
    todo = todo[np.argsort(gram_of[todo], kind="stable")]
    batch: list[int] = []
    held = 0
    for j, i in enumerate(todo.tolist()):
        batch.append(i)
        held += len(strings[i])
        if j + 1 == len(todo) or held > MERGE_BYTES and gram_of[todo[j + 1]] != gram_of[i]:
            found, begin = least_owners([strings[k] for k in batch], least[batch], window)
            first[np.repeat(base[batch] - begin[:-1], np.diff(begin)) + np.arange(len(found))] = found
            batch, held = [], 0
    late = owner > least[which]  # a smaller document has the whole context
    some = np.flatnonzero(~late)
    count = windows[which[some]]
    entry = np.repeat(some, count)
    begin = np.cumsum(count) - count
    inner = np.arange(len(entry)) - np.repeat(begin, count)
    a, b = W.runs(first[base[which[entry]] + inner] < owner[entry], entry)
    return np.concatenate([owner[late], owner[entry[a]]]), np.concatenate([place[late], place[entry[a]] + inner[a]]), np.concatenate([windows[which[late]], b - a])


def _finish(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, r in zip(batch.column("text"), starts_and_counts(batch.column("own"), batch.column("runs"))):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            r = r[r.sum(1) + window - 1 <= len(data)]
            gone = W.cover(len(data), r[:, 0], r.sum(1) + window - 1)
            removed.append(int(gone.sum()))
            spans.append(len(W.runs(gone)[0]))
            digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay."""
    source = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NULL_ID))))

    def ask(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        x = Anchors(c, window, gram)
        at = x.places()
        return np.searchsorted(c.starts, at, "right") - 1, x.grams[at]

    n = shards(source, per_shard)
    found = stored(noted(source, ask, False, hot).mapInArrow(lambda it: _contexts(it, n, window, gram), CONTEXTS), "contexts")
    runs = judged(found.where("shard is not null").select(*ASKS), n, lambda rows: _judge(rows, window, gram), "removed-runs")
    plain = found.where("shard is null and text is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    waiting = with_runs(found.where("shard is null and text is not null").select("doc_id", "n_bytes", "text", "own"), runs)
    done = waiting.mapInArrow(lambda it: _finish(it, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.unionByName(done).withColumn("doc_id", F.when(F.col("doc_id") != int(NULL_ID), F.col("doc_id")))
