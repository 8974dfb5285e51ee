"""Candidates of an exact similarity join: all pairs of texts whose shingle sets can reach a Jaccard threshold.

Shingles get one order for all texts. Two sets of Jaccard t or above share at least ceil(t * n) of the n shingles of either,
so both have one of the shared ones among their first n - ceil(t * n) + 1: texts that meet under no such shingle need no
comparison, and every pair at the threshold meets. Any order will do; this one puts shingles last that have been seen under
many texts, by a table of RANKS slots of fixed size (a slot's shingles count as its most frequent one), then goes by hash.
So a passage that many texts hold is used only where a text holds little else.

Under a shingle, pairs are made of texts that no link joins yet, whose sizes and places of the shingle allow the threshold.
Where more than SMALL texts meet, as many edited copies of one text do, a pair must also pass their bitmaps: each has a bit
for about each shingle, the parity of the shingles that fall on it, so that two texts differ in at least as many shingles as
their bitmaps do in bits. That is exact too, and leaves few pairs below the threshold.

Such pairs grow with the square of the copies and do not leave their task: what leaves it is a spanning forest of the labels
that they join. Texts whose labels a path of such pairs joins are a group; `linked` sends their shingle sets to cells, once
each where the group is small, compares them there exactly and again gives only a spanning forest of the labels. A pair at
the threshold is in one group, so its labels are joined in the end; no pair below it is given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Chunk, by_shard, chunks, lean, release, shards, stored
from .exchange import dealt, expand, squeeze

#: Texts under a shingle from which it goes to the end of the order, slots of the order's table, times it is refined.
HOT, RANKS, ROUNDS = 32, 1 << 22, 2
#: Texts under a shingle up to which bitmaps are not asked for, and from which they are compared in several tasks: block
#: against block of this many.
SMALL, PART = 8, 1024
#: Shingles of a block of texts that are compared by their sets, if it has more than one text.
SHINGLES = 1 << 20


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[Chunk, list[np.ndarray]]]:
    """Chunks with the sorted distinct hashes of their texts' shingles; fewer words than `words` are one, no words are one too."""
    for c in chunks(batches, limit=1 << 19):
        a, b, doc = W.words(c.data, c.starts)
        sums = W.prefix(W.word_hashes(c.data, a, b))
        grams = W.mix(W.grams(sums, words), 31)
        first = np.searchsorted(doc, np.arange(c.n + 1))
        few = W.mix(W.spans(sums, first[:-1], first[1:]), 32)
        yield c, [np.unique(grams[s : e - words + 1]) if e - s >= words else few[i : i + 1] for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))]


def _prefix(s: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set that the threshold asks for, in order."""
    p = len(s) - math.ceil(len(s) * similarity - 1e-9) + 1
    rank = ranks[s & np.uint64(RANKS - 1)]
    return s[np.argsort(rank, kind="stable")[:p]] if rank.any() else s[:p]


def _frequent(source: DataFrame, words: int, similarity: float, ranks: np.ndarray, hot: int, n: int) -> DataFrame:
    """(slot, c): by slot of the order's table the most texts, over `hot`, that have one of its shingles in their prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sets in _shingles(batches, words):
            h, seen = np.unique(np.concatenate([_prefix(s, ranks, similarity) for s in sets]), return_counts=True)
            place, cuts = dealt(h, n)
            rows = [(s, squeeze(h[p], seen[p].astype("<u4"))) for s in np.flatnonzero(np.diff(cuts)).tolist() for p in (place[cuts[s] : cuts[s + 1]],)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [expand(x.as_buffer(), "<u8", "<u4")[0] for b in batches for x in b.column("packed")]
        if rows:
            h, which = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([r[1] for r in rows])).astype(np.int64)
            some = np.flatnonzero(total > hot)
            yield pa.RecordBatch.from_arrays([pa.array((h[some] & np.uint64(RANKS - 1)).astype(np.int64)), pa.array(total[some])], ["slot", "c"])

    return by_shard(source.mapInArrow(lean(count), "shard int, packed binary"), n).mapInArrow(lean(add), "slot long, c long").groupBy("slot").agg(F.max("c").alias("c"))


def order(source: DataFrame, words: int, similarity: float, n: int, hot: int = HOT, rounds: int = ROUNDS) -> np.ndarray:
    """The order's table: for each slot the logarithm of its most frequent shingle's texts, 0 for none over `hot`."""
    ranks = np.zeros(RANKS, np.uint8)
    for _ in range(rounds):
        seen = _frequent(source, words, similarity, ranks, hot, n).toArrow()  # at most RANKS rows
        at, rank = seen["slot"].to_numpy(), np.ceil(np.log2(seen["c"].to_numpy().astype(np.float64))).astype(np.uint8)
        if not (rank > ranks[at]).any():
            break
        ranks = ranks.copy()  # the plans made so far hold the former
        ranks[at] = np.maximum(ranks[at], rank)
    return ranks


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles on a number of places, a power of two from 64 on and no less than their number."""
    places = 64
    while places < len(shingles):
        places *= 2
    seen = np.bincount((shingles >> np.uint64(24) & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(seen & 1 == 1, bitorder="little").tobytes()


class Bitmaps:
    """The bitmaps of a bucket's texts; one of twice the places folds to the half by parity."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bits])
        self.rows, self.place = {}, {}
        for w in np.unique(self.words).tolist():
            same, twice = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            full = np.frombuffer(b"".join([bits[i] for i in same.tolist()]), np.uint64).reshape(-1, w)
            half = np.frombuffer(b"".join([bits[i] for i in twice.tolist()]), np.uint64).reshape(-1, 2, w)
            self.rows[w] = np.concatenate([full, half[:, 0] ^ half[:, 1]])
            self.place[w] = np.full(len(bits), -1)
            self.place[w][np.concatenate([same, twice])] = np.arange(len(same) + len(twice))

    def differ(self, x: np.ndarray, y: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Bits in which pairs differ; x has no more places than y, and half of them at least."""
        out = np.zeros(len(x), np.int64)
        for w, rows in self.rows.items():
            mine = np.flatnonzero(self.words[x] == w)
            for at in range(0, len(mine), max(1, block // w)):
                some = mine[at : at + max(1, block // w)]
                out[some] = np.bitwise_count(rows[self.place[w][x[some]]] ^ rows[self.place[w][y[some]]]).sum(1)
        return out


def _pairs(ids, n, at, label, similarity: float, bits: list[bytes] | None = None, side: np.ndarray | None = None, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that differ in label and whose overlap can reach the threshold if this shingle is their first. Of a
    cell with two sides only pairs across."""
    order = np.lexsort((ids, n))
    across = side[order] if side is not None and side.any() else None
    ids, n, at, label = ids[order], n[order], at[order], label[order]
    maps = Bitmaps([bits[i] for i in order.tolist()]) if bits else None
    # Of a larger set of m, a smaller one needs ceil(m * similarity).
    ends = np.searchsorted(n, np.floor(n / similarity + 1e-9), "right")
    rows = max(1, block // len(ids))
    for s in range(0, len(ids), rows):
        e = min(len(ids), s + rows)
        y = np.arange(s + 1, int(ends[s:e].max()))
        x = np.arange(s, e)
        if not len(y):
            continue
        need = np.ceil((n[x][:, None] + n[y]) * (similarity / (1 + similarity)) - 1e-9)
        can = (y > x[:, None]) & (y < ends[x][:, None]) & (label[x][:, None] != label[y])
        can &= np.minimum((n[x] - at[x])[:, None], n[y] - at[y]) >= need
        i, j = np.nonzero(can)
        if across is not None:
            apart = across[x[i]] != across[y[j]]
            i, j = i[apart], j[apart]
        if maps and len(i):
            ok = maps.differ(x[i], y[j]) <= n[x[i]] + n[y[j]] - 2 * need[i, j]
            i, j = i[ok], j[ok]
        yield ids[x[i]], ids[y[j]]


class _Emitter:
    """Pairs, each once among some hundred thousand, however often it comes."""

    def __init__(self):
        self.x, self.y, self.held = [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x.append(x), self.y.append(y)
        self.held += len(x)

    def take(self, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held < least:
            return
        x, y = np.concatenate(self.x), np.concatenate(self.y)
        x, y = np.minimum(x, y), np.maximum(x, y)
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.x, self.y, self.held = [], [], 0
        yield x[first], y[first]


def _met(batches: Iterator[pa.RecordBatch], shard_bits: int, similarity: float, small: int) -> Iterator[pa.RecordBatch]:
    """Of a shard's postings the pairs x, y under shingles of few texts; under the others the texts x at their places y, the
    shingle being `bucket`. A bucket of several blocks has a cell for each pair of them, on whose sides they stand."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("bucket", pa.int64()), ("cell", pa.int32()), ("side", pa.int8())])
    nothing = lambda n: [pa.nulls(n, f.type) for f in schema][2:]
    shards, rows = [], []
    for b in batches:
        for shard, x in zip(b.column("shard").to_pylist(), b.column("packed")):
            shards.append(shard)
            rows.append(expand(x.as_buffer(), "<u4", "<i8", "<i8", "<i4", "<i4")[0])
    if not rows:
        return
    h, node, label, n, at = (np.concatenate(x) for x in zip(*rows))
    h = h.astype(np.int64) << shard_bits | np.repeat(np.array(shards, np.int64), [len(r[0]) for r in rows])
    o = np.argsort(h, kind="stable")
    h, node, label, n, at = h[o], node[o], label[o], n[o].astype(np.int64), at[o].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    sizes = np.diff(cuts)
    mixed = np.maximum.reduceat(label, cuts[:-1]) != np.minimum.reduceat(label, cuts[:-1])
    out = _Emitter()
    two = cuts[:-1][(sizes == 2) & mixed]  # most
    low, high = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
    need = np.ceil((low + high) * (similarity / (1 + similarity)) - 1e-9)
    two = two[(high <= low / similarity + 1e-9) & (np.minimum(n[two] - at[two], n[two + 1] - at[two + 1]) >= need)]
    out.add(node[two], node[two + 1])
    for i in np.flatnonzero((sizes > 2) & (sizes <= small) & mixed).tolist():
        s, e = cuts[i], cuts[i + 1]
        for a, b in _pairs(node[s:e], n[s:e], at[s:e], label[s:e], similarity):
            out.add(a, b)
    for x, y in out.take():
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *nothing(len(x))], schema=schema)
    whole = np.flatnonzero(np.repeat((sizes > small) & (sizes <= PART) & mixed, sizes))
    if len(whole):
        yield pa.RecordBatch.from_arrays([pa.array(node[whole]), pa.array(at[whole]), pa.array(h[whole]), *(pa.array(np.zeros(len(whole), k)) for k in (np.int32, np.int8))], schema=schema)
    for i in np.flatnonzero((sizes > max(small, PART)) & mixed).tolist():
        blocks = -(-sizes[i] // PART)
        members = np.arange(cuts[i], cuts[i + 1])
        own = np.arange(len(members)) % blocks
        for other in range(blocks):
            # Each block beside each: the lower one is the cell's first side.
            cell, side = np.minimum(own, other) * blocks + np.maximum(own, other), (own > other).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(node[members]), pa.array(at[members]), pa.array(h[members]), pa.array(cell.astype(np.int32)), pa.array(side)], schema=schema)


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs under shingles of many texts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    h, cell, side, node, label, n, at = (np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("bucket", "cell", "side", "node", "label", "n", "at"))
    bits = [x for b in held for x in b.column("bits").to_pylist()]
    o = np.lexsort((cell, h))
    cuts = np.flatnonzero(np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (cell[o][1:] != cell[o][:-1]), [True]])).tolist()
    out = _Emitter()
    for s, e in zip(cuts, cuts[1:]):
        i = o[s:e]
        for a, b in _pairs(node[i], n[i], at[i], label[i], similarity, [bits[k] for k in i.tolist()], side[i]):
            out.add(a, b)
        for x, y in out.take(1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    for x, y in out.take():
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])


def _joined(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the labels that pairs under shingles of many texts join."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    node, first = np.unique(np.concatenate([b.column("node").to_numpy() for b in held]), return_index=True)
    labels, own = np.unique(np.concatenate([b.column("label").to_numpy() for b in held])[first], return_inverse=True)
    parent = np.arange(len(labels)).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pairs in _compared(held, similarity):
        roots = np.array([root(x) for x in range(len(labels))])
        x, y = (roots[own[np.searchsorted(node, pairs.column(c).to_numpy())]] for c in ("x", "y"))
        apart = np.unique((np.minimum(x, y) * len(labels) + np.maximum(x, y))[x != y])
        made = []
        for x, y in zip((apart // len(labels)).tolist(), (apart % len(labels)).tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                made.append((x, y))
        if made:
            a, b = np.array(made).T
            yield pa.RecordBatch.from_arrays([pa.array(labels[a]), pa.array(labels[b])], ["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of rows in the order of their cells."""
    held, last = [], None
    for b in batches:
        cell = b.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and cell[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = cell[s]
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _links(cell: pa.Table, similarity: float, limit: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning forest of a cell's labels, by pairs of nodes whose sets `s` reach the threshold."""
    node, label, side = (cell.column(c).to_numpy() for c in ("node", "label", "side"))
    n = cell.column("s").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    starts = np.cumsum(n) - n
    shingles = np.concatenate([x.flatten().to_numpy() for x in cell.column("s").chunks]).view(np.uint64)
    bits = [bitmap(shingles[s : s + k]) for s, k in zip(starts.tolist(), n.tolist())]
    names, shingles = np.unique(shingles, return_inverse=True)
    part = np.unique(label, return_inverse=True)[1]  # what the links so far join has one number
    has, out = np.zeros(len(names), bool), []
    for x, y in _pairs(np.arange(len(node)), n, np.zeros(len(node), np.int64), label, similarity, bits, side):
        apart = part[x] != part[y]
        x, y = x[apart], y[apart]
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist() if len(x) else []
        for s, e in zip(cuts, cuts[1:]):
            i = int(x[s])
            own = shingles[starts[i] : starts[i] + n[i]]
            has[own] = True
            ends = np.cumsum(n[y[s:e]])
            at = 0
            while at < e - s:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
                j = y[s + at : s + to]
                at = to
                j = j[part[j] != part[i]]
                sizes = n[j]
                which = np.repeat(np.arange(len(j)), sizes)
                place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[j][which]
                common = np.bincount(which, weights=has[shingles[place]], minlength=len(j))
                j = j[common >= similarity * (n[i] + sizes - common) - 1e-9]
                for k in j[np.unique(part[j], return_index=True)[1]].tolist():
                    out.append((int(node[i]), int(node[k])))
                    part[part == part[k]] = part[i]
            has[own] = False
    return out


def linked(sets: DataFrame, similarity: float, n: int, part: int = PART, shingles: int = SHINGLES) -> DataFrame:
    """(a, b): pairs of nodes at the threshold that join the labels of each group as all such pairs in it would.

    `sets` is a stored table of node, label, grp and s, the node's distinct shingles. A label that fills blocks of `part`
    texts or `shingles` has its own, which are not compared with each other; the others of a group share blocks. Each block
    meets each in a cell."""
    sized = sets.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("s")).alias("w"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / part), F.ceil(F.col("w") / shingles)).cast("int")
    # Labels are not negative: -1 are the blocks that small ones share.
    whole = (F.col("c") >= part) | (F.col("w") >= shingles)
    owners = sized.groupBy("grp", F.when(whole, F.col("label")).otherwise(F.lit(-1)).alias("own")).agg(F.sum("c").alias("c"), F.sum("w").alias("w")).select("grp", "own", blocks.alias("blocks"))
    owners = stored(owners, "owners")
    large = owners.where("own >= 0").select(F.col("grp").alias("_g"), F.col("own").alias("_o"), F.col("blocks").alias("_b"))
    shared = owners.where("own < 0").select(F.col("grp").alias("_r"), F.col("blocks").alias("_c"))
    placed = sets.join(large, (F.col("grp") == F.col("_g")) & (F.col("label") == F.col("_o")), "left").join(shared, F.col("grp") == F.col("_r"), "left")
    placed = placed.select("grp", F.coalesce("_o", F.lit(-1)).alias("own"), F.pmod(F.xxhash64("node"), F.coalesce("_b", "_c")).cast("int").alias("block"), "node", "label", "s")
    block = owners.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.struct("own", "block").alias("p"))
    both = block.join(block.select("grp", F.col("p").alias("q")), "grp").where("p < q and p.own <> q.own or p.own = -1 and q.own = -1 and p <= q")
    cells = stored(both.withColumn("cell", F.monotonically_increasing_id()), "cells")
    sides = cells.select("grp", "p.own", "p.block", "cell", F.lit(0).alias("side")).unionByName(cells.where("p <> q").select("grp", "q.own", "q.block", "cell", F.lit(1).alias("side")))
    dealt_out = placed.join(sides, ["grp", "own", "block"]).select(F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int").alias("shard"), "cell", "side", "node", "label", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            found = np.array(_links(cell, similarity), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return by_shard(dealt_out, n).sortWithinPartitions("cell").mapInArrow(lean(compare), "a long, b long")


def candidates(source: DataFrame, nodes: DataFrame, words: int, similarity: float, hot: int = HOT, rounds: int = ROUNDS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Of the pairs of nodes that can reach the threshold and whose labels differ, stored: (x, y), x < y, those under
    shingles of at most `small` texts; (a, b) labels, which join all labels that the other pairs join.

    `source` has doc_id, digest and text, `nodes` has doc_id, digest, node and label: the texts to compare."""
    n = shards(source)
    shard_bits = max(1, (n - 1).bit_length())
    ranks = order(source, words, similarity, n, hot, rounds)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sets in _shingles(batches, words):
            kept = [_prefix(s, ranks, similarity).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("digest"), pa.array(list(map(len, sets)), pa.int32()), pa.array(kept, pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary())], ["doc_id", "digest", "n", "hs", "bits"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, "hs"):
            h, sizes = c.data.view(np.uint64), np.diff(c.starts) // 8
            at = np.arange(len(h)) - np.repeat(c.starts[:-1] // 8, sizes)
            node, label, m = (np.repeat(c.column(k).to_numpy(), sizes) for k in ("node", "label", "n"))
            place, cuts = dealt(h, n)
            # Within a shard of bounded size 32 bits tell shingles apart but for a few, whose pairs are compared for nothing.
            low = (h >> np.uint64(20)).astype("<u4")
            rows = [(s, squeeze(low[p], node[p], label[p], m[p].astype("<i4"), at[p].astype("<i4"))) for s in np.flatnonzero(np.diff(cuts)).tolist() for p in (place[cuts[s] : cuts[s + 1]],)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "packed"])

    made = source.mapInArrow(lean(prefixes), "doc_id long, digest binary, n int, hs binary, bits binary")
    nodes = nodes.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_g"), "node", "label")
    sketches = stored(made.join(nodes.hint("shuffle_hash"), (F.col("doc_id") == F.col("_i")) & (F.col("digest") == F.col("_g"))).select("node", "label", "n", "hs", "bits"), "sketches")
    met = stored(by_shard(sketches.select("node", "label", "n", "hs").mapInArrow(lean(deal), "shard int, packed binary"), n).mapInArrow(lean(lambda it: _met(it, shard_bits, similarity, small)), "x long, y long, bucket long, cell int, side byte"), "met")
    large = met.where("bucket is not null").select("bucket", "cell", "side", F.col("x").alias("_n"), F.col("y").cast("int").alias("at"))
    known = sketches.select("node", "label", "n", "bits").dropDuplicates(["node"])
    large = large.join(known, F.col("_n") == F.col("node")).select(F.pmod(F.xxhash64("bucket", "cell"), F.lit(n)).cast("int").alias("shard"), "bucket", "cell", "side", "node", "label", "n", "at", "bits")
    joined = stored(by_shard(large, n).mapInArrow(lean(lambda it: _joined(it, similarity)), "a long, b long").distinct(), "joined-labels")
    out = stored(met.where("bucket is null").select("x", "y").distinct(), "prefix-pairs")
    release(sketches, met)
    return out, joined
