"""Token ids in binary files of patched frame-of-reference blocks.

A block holds BLOCK ids: its least id, the rest as differences from it at a width that a percentile of them needs, and
a list of exceptions (place, high bits) for the wider ones. The percentile, PERCENTILE at least, is the block's own: the
one whose width makes the block smallest. A file holds the documents of one id range in ascending
order, each with its end id:

    b"PFR1" | blocks | index of block starts (u64) | directory: document ids (i64), null marks (u8), starts in ids (u64)
    | footer: counts of ids, blocks and documents, offsets of index and directory (5 x u64) | b"PFR1"

    block: least id u32 | width u8 | exceptions u16 | packed 64-bit words | places u8 | high bits u32

so any run of ids is read from its own blocks alone.

Defined cases: a null text has only its end id; null ids are kept and come first; rows of one id come in the order of the
XXH64 of their texts, so repeated rows lie one after another; very long texts are encoded in parts and stored whole; blocks
whose widths tie take the least; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, scratch, stored, texts
from .tokens import encoder

BLOCK, PERCENTILE, MAGIC = 256, 75, b"PFR1"
#: Ids in memory at a time, in the writer and in the reader.
RUN = 1 << 18
HEAD = struct.Struct("<IBH")
FOOT = struct.Struct("<5Q")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 64 words."""
    out = np.zeros((len(v), BLOCK * width // 64), np.uint64)
    for j in range(BLOCK if width else 0):
        word, bit = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - bit)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, bit = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - bit))
        out[:, j] = x & mask
    return out


def _widths(v: np.ndarray) -> np.ndarray:
    """The width of each row: over all that hold PERCENTILE of its values, the one with the fewest bytes."""
    bits = np.frexp(v.astype(np.float64))[1]
    each = np.bincount((np.arange(len(v))[:, None] * 33 + bits).ravel(), minlength=33 * len(v)).reshape(-1, 33)
    held = np.cumsum(each, 1)
    size = np.arange(33) * (BLOCK // 8) + (BLOCK - held) * 5
    size[held * 100 < BLOCK * PERCENTILE] = 1 << 30
    return size.argmin(1)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Each BLOCK of uint32 ids as bytes; a short last block is filled up with its last id."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    v = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    least = v.min(1)
    v = v - least[:, None]
    widths = _widths(v)
    out: list[bytes] = [b""] * n
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        part = v[rows]
        wide = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        packed = _pack((part & np.uint32((1 << w) - 1)).astype(np.uint64), w)
        r, place = np.nonzero(wide)
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        place, high = place.astype(np.uint8), wide[r, place].astype("<u4")
        for i, row in enumerate(rows.tolist()):
            a, b = ends[i], ends[i + 1]
            out[row] = HEAD.pack(int(least[row]), w, b - a) + packed[i].tobytes() + place[a:b].tobytes() + high[a:b].tobytes()
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at `starts` in raw."""
    if not len(starts):
        return np.empty(0, np.uint32)
    heads = [HEAD.unpack_from(raw, s) for s in starts.tolist()]
    least, widths, counts = (np.array(c, np.int64) for c in zip(*heads))
    data, out = np.frombuffer(raw, np.uint8), np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        words = data[(starts[rows, None] + HEAD.size) + np.arange(BLOCK * w // 8)].view(np.uint64) if w else np.zeros((len(rows), 0), np.uint64)
        out[rows] = _unpack(words, w)
    some = np.flatnonzero(counts)
    if len(some):
        n = counts[some]
        row = np.repeat(some, n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[some] + HEAD.size + BLOCK * widths[some] // 8, n)
        place = data[at + inner]
        high = data[(at + np.repeat(n, n) + 4 * inner)[:, None] + np.arange(4)].view("<u4")[:, 0]
        out[row, place] |= high << widths[row].astype(np.uint32)
    return (out + least[:, None].astype(np.uint32)).reshape(-1)


class Writer:
    """Appends documents to an open file, with a run of ids in memory."""

    def __init__(self, sink):
        self.sink, self.at, self.n = sink, len(MAGIC), 0
        self.blocks, self.ids, self.null, self.starts = [], [], [], []
        self.waiting, self.held = [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0), self.null.append(doc_id is None), self.starts.append(self.n)
        self.n += len(ids)
        for i in range(0, len(ids), RUN):
            self.waiting.append(ids[i : i + RUN])
            self.held += len(self.waiting[-1])
            if self.held >= RUN:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        v = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        whole = len(v) if last else len(v) // BLOCK * BLOCK
        made = encode_blocks(v[:whole])
        for b in made:
            self.blocks.append(self.at)
            self.at += len(b)
        self.sink.write(b"".join(made))
        self.waiting, self.held = [v[whole:]], len(v) - whole

    def close(self) -> int:
        self._flush(True)
        index = np.array(self.blocks, "<u8").tobytes()
        directory = np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.sink.write(index + directory + FOOT.pack(self.n, len(self.blocks), len(self.ids), self.at, self.at + len(index)) + MAGIC)
        self.sink.close()
        return self.at + len(index) + len(directory) + FOOT.size + len(MAGIC)


class Reader:
    """Random access to a file's documents; `source` has size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        tail = self._read(source.size() - FOOT.size - 4, FOOT.size + 4)
        if tail[-4:] != MAGIC:
            raise ValueError("not a file of patched frames")
        self.n, blocks, docs, index, directory = FOOT.unpack(tail[:-4])
        self.end = index
        self.blocks = np.frombuffer(self._read(index, 8 * blocks), "<u8").astype(np.int64)
        raw = self._read(directory, 17 * docs)
        self.ids, self.null = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64), self.n)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) from the blocks that hold them."""
        if start >= end:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        at = self.blocks[a:b]
        stop = int(self.blocks[b]) if b < len(self.blocks) else self.end
        return decode_blocks(self._read(int(at[0]), stop - int(at[0])), at - at[0])[start - a * BLOCK : end - a * BLOCK]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document's place, some of its ids in order), all documents once through."""
        d = 0
        for at in range(0, self.n, RUN):
            v = self.tokens(at, min(at + RUN, self.n))
            while d < len(self.ids) and self.starts[d] < at + len(v):
                yield d, v[max(0, self.starts[d] - at) : self.starts[d + 1] - at]
                if self.starts[d + 1] > at + len(v):
                    break
                d += 1


class Bounds:
    """File numbers of rows by id and by the hash of the text: `ids` are the least ids of the files but the first.

    An id that fills several files by itself is among them several times; its rows are dealt to these by their hash."""

    def __init__(self, ids: list[int]):
        self.ids, self.times = np.unique(np.array(ids, np.int64), return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(self.times)])

    @property
    def files(self) -> int:
        return int(self.before[-1]) + 1

    def file(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int32)
        at = np.searchsorted(self.ids, ids, "right")  # bounds up to the id
        out = self.before[at]
        mine = np.flatnonzero((at > 0) & (self.ids[np.maximum(at, 1) - 1] == ids))
        times = self.times[at[mine] - 1]
        # Signed hashes in their order, which is that of the rows within an id.
        place = (hashes[mine].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        out[mine] += ((place * times.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + 1 - times
        return out.astype(np.int32)


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", per_file: int = 64 << 20) -> DataFrame:
    """Encodes, orders by id and writes; a row for each file: path, file, docs, ids, bytes. The rows are the manifest:
    a file that a failed or repeated task left is not in it. `per_file` is in bytes of input; writing streams."""
    from pyarrow import fs

    spark = docs.sparkSession
    source = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    folder = scratch(spark, "token-files")
    # Range bounds come from the id column alone; the encoder runs once and only ids are shuffled.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(source) // per_file))
    least = int(np.iinfo(np.int64).min)
    cuts = F.percentile_approx(F.coalesce("doc_id", F.lit(least)), [i / n for i in range(1, n)] or [0.5], 5 * n).alias("cuts")
    bounds = Bounds((source.agg(cuts).first()["cuts"] or []) if n > 1 else [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                file = bounds.file(part.column("doc_id").fill_null(least).to_numpy(zero_copy_only=False), part.column("h").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(enc.encode(part.column("text")), pa.binary()), pa.array(file)], ["doc_id", "h", "ids", "file"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, out, file = encoder(tokenizer).dtype, None, None
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for doc, raw, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "file"))):
                if out is None:
                    file, name = k, f"{root}/ids-{k:07d}-{uuid.uuid4().hex[:8]}.pfr"
                    out = Writer(where.open_output_stream(name))
                out.add(doc, np.append(np.frombuffer(raw, dtype), np.array(end_id, dtype)).astype(np.uint32))
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([file], pa.int32()), pa.array([len(out.ids)], pa.int64()), pa.array([out.n], pa.int64()), pa.array([size], pa.int64())], ["path", "file", "docs", "ids", "bytes"])

    encoded = source.mapInArrow(encode, "doc_id long, h long, ids binary, file int")
    dealt = encoded.repartitionById(bounds.files, F.col("file")).sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "h")
    return stored(dealt.mapInArrow(save, "path string, file int, docs long, ids long, bytes long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyarrow import fs
    from pyspark.sql import Window

    base = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    files = manifest.select("path", base.alias("base"))
    files = files.repartition(max(1, manifest.count()))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    r = Reader(f)
                    crc = np.zeros(len(r.ids), np.int64)
                    for d, v in r.runs():
                        crc[d] = zlib.crc32(v.astype("<u4"), int(crc[d]))
                yield pa.RecordBatch.from_arrays([pa.array(r.ids, mask=r.null.astype(bool)), pa.array(r.starts[:-1] + base), pa.array(np.diff(r.starts)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
