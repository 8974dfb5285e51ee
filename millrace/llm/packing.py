"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are encoded once; one longer than the capacity is cut into pieces, of which the first may be shorter. Bin
packing sees only how many pieces there are of each length, at most `capacity` numbers, so the plan is made from that
histogram alone, whatever the corpus' size: first the reduction fixes bins that some optimal packing has, then
best-fit decreasing places what remains, many equal bins at a time. The pieces of a length are numbered in parallel
(within shards, then by the shards' offsets), and a piece's number leads to its bin.

Defined cases: a null text is empty and has only its end id; null ids are kept, as the smallest; repeated rows are
packed one by one; very long texts are encoded in parts and cut into as many pieces as they need; pieces of one length are
numbered by partition and place in it, and of bins equally full the one planned first is taken; an empty table gives no
rows; other columns are ignored. Each piece is packed whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .tokens import encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, share int, row long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, share, row = encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, at, start, length, crc = [], [], [], [], []
        docs = batch.column("doc_id").to_pylist()
        for i in range(0, batch.num_rows, 512):
            for doc, raw in zip(docs[i : i + 512], enc.encode(batch.column("text").slice(i, 512))):
                v = np.append(np.frombuffer(raw, enc.dtype), np.array(end_id, enc.dtype)).astype("<u4")
                first = len(v) % capacity or capacity
                cuts = [0, *range(first, len(v) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    ids.append(doc), at.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(v[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([share] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "share", "row"])
        row += len(ids)


class Plan:
    """Runs of equal bins: (count of bins, lengths in the bin)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.fixed = capacity, [], 0

    def add(self, times: int, lengths: tuple[int, ...], fixed: bool = False) -> None:
        self.runs.append((times, lengths))
        self.fixed += times * fixed

    @property
    def bins(self) -> int:
        return sum(n for n, _ in self.runs)

    def slots(self) -> dict[int, tuple[np.ndarray, ...]]:
        """By length: the first number of each run, its first bin, its bins, and the place in the bin."""
        out, base = {}, 0
        for times, lengths in self.runs:
            place = 0
            for s in lengths:
                rows = out.setdefault(s, [])
                rows.append((rows[-1][0] + rows[-1][2] if rows else 0, base, times, place))
                place += s
            base += times
        return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in out.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A packing of histogram[s] pieces of each length s <= capacity.

    The reduction follows Martello and Toth: the bin {j} with the largest piece j dominates every other bin with j if
    not even the smallest other piece fits beside it; {j, k} does if k fills the bin, or if k is the largest that fits
    and no two other pieces fit beside j together, or no two that fit are larger together; {j, a, b} does if three do not
    fit, a and b are the two that fit with the largest sum, a is the largest that fits alone, and every other two that fit
    have a smaller second piece. Such bins are in some optimal packing and are fixed."""
    out, left = Plan(capacity), {s: n for s, n in histogram.items() if n}
    sizes = sorted(left)

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del left[s]
            sizes.pop(bisect_left(sizes, s))

    # Pieces that one other fills up exactly: fixed wherever they are, the largest first.
    for s in sorted(left, reverse=True):
        mate = capacity - s
        if s not in left:
            continue
        if mate == 0:
            n = left[s]
            take(s, n)
            out.add(n, (s,), True)
        elif mate in left and mate <= s:
            n = left[s] // 2 if mate == s else min(left[s], left[mate])
            if n:
                take(s, n)
                take(mate, n)
                out.add(n, (s, mate), True)
    while sizes:
        s = sizes[-1]
        room = capacity - s
        if sizes[0] > room:
            n = left[s]
            take(s, n)
            out.add(n, (s,), True)
            continue
        # The two smallest pieces other than this one.
        others = [x for x in sizes[:3] for _ in range(min(2, left[x] - (x == s)))][:2]
        two = sum(others) if len(others) == 2 else capacity
        if two > room:
            at = bisect_right(sizes, room) - 1
            while at >= 0 and left[sizes[at]] <= (sizes[at] == s):
                at -= 1
            if at < 0:  # no other piece fits
                take(s, 1)
                out.add(1, (s,), True)
                continue
            k = sizes[at]
            n = left[s] // 2 if k == s else min(left[s], left[k])
            take(s, n)
            take(k, n)
            out.add(n, (s, k), True)
            continue
        found = _dominating(sizes, left, s, room)
        if found:
            need = {x: ((s,) + found).count(x) for x in {s, *found}}
            # As often as the counts that the rule saw stay as they are to it: three of each.
            n = max(1, min((left[x] - 3) // c for x, c in need.items()))
            for x, c in need.items():
                take(x, n * c)
            out.add(n, (s, *found), True)
            continue
        # Best fit for the remainder: fill a bin around the largest piece, then use the same bin while it lasts.
        bin_, need = [s], {s: 1}
        while room >= sizes[0]:
            at = bisect_right(sizes, room) - 1
            while at >= 0 and left[sizes[at]] <= need.get(sizes[at], 0):
                at -= 1
            if at < 0:
                break
            k = sizes[at]
            pair = _closing_pair(sizes, left, need, room)
            for x in pair if pair and sum(pair) > k else (k,):
                bin_.append(x)
                need[x] = need.get(x, 0) + 1
                room -= x
        n = min(left[x] // c for x, c in need.items())
        for x, c in need.items():
            take(x, n * c)
        out.add(n, tuple(bin_))
    return out


def _dominating(sizes: list[int], left: dict[int, int], s: int, room: int) -> tuple[int, ...] | None:
    """The one or two pieces that with the largest, s, dominate all else, where two but not three fit beside it."""
    count = lambda x: left[x] - (x == s)
    three = [x for x in sizes[:4] for _ in range(min(3, count(x)))][:3]
    if len(three) == 3 and sum(three) <= room:
        return None
    small = [x for x in sizes[: bisect_right(sizes, room)] if count(x)]
    # The two of the largest sum that fit, and of these the ones that lie furthest apart.
    best, pair, i, j = -1, None, 0, len(small) - 1
    while i <= j:
        total = small[i] + small[j]
        if total > room:
            j -= 1
            continue
        # small[j] is the largest that fits beside small[i]
        if (i < j or count(small[i]) > 1) and total > best:
            best, pair = total, (small[j], small[i])
        i += 1
    one = small[-1]
    if pair is None or one >= best:
        return (one,)
    if pair[0] != one:
        return None
    # Two that fit whose smaller piece is larger than pair[1]: the least two such would fit.
    above = [x for x in small[bisect_right(small, pair[1]) :][:2] for _ in range(min(2, count(x)))][:2]
    return pair if len(above) < 2 or sum(above) > room else None


def _closing_pair(sizes: list[int], left: dict[int, int], need: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two pieces that together fill the room exactly, if there are such."""
    for k in sizes:
        if 2 * k > room:
            return None
        other = room - k
        if other in left and left[k] > need.get(k, 0) and left[other] > need.get(other, 0) + (other == k):
            return other, k
    return None


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = stored(texts(docs, id_col, text_col).mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end_id), PIECES), "pieces")
    # Counts by (share, length): at most `capacity` a share, summed to numbers that offset each share.
    counts = made.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = plan(histogram, capacity).slots()
    # Numbers start at first(length, share): a running sum over the shares of a length.
    from pyspark.sql import Window

    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length").alias("_l"), F.col("share").alias("_s"), F.coalesce("first", F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("share", "length").orderBy("row")) - 1
    numbered = made.withColumn("k", number).join(first.hint("merge"), (F.col("length") == F.col("_l")) & (F.col("share") == F.col("_s")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("first")).alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, k = (batch.column(c).to_numpy() for c in ("length", "k"))
            seq, off = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(k) else ():
                begin, base, _, at = slots[int(size[part[0]])]
                r = np.searchsorted(begin, k[part], "right") - 1
                seq[part], off[part] = base[r] + k[part] - begin[r], at[r]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
