"""Media columns in Matroska: EBML elements read and written, and packet tables of blobs.

`parse` walks a blob's variable-length elements (unknown sizes too) and yields a packet for each frame of each block:
its track, timestamp, key flag and byte range, through Xiph, EBML and fixed-size lacing, with the cues that point to
it. `write` makes a file of one track of 8-bit PCM samples in clusters of laced blocks, with cues.

Defined cases: a null or empty text is one frame of padding; a null blob has no packets, a damaged one those before the
damage; repeated rows are handled one by one; very long texts fill as many clusters as they need; packets of one time come
in the order of their bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

# Element ids of the public Matroska and EBML specifications.
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose content is elements, and those that may have an unknown size.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Top-level elements: an element of unknown size ends where one of its own level or above starts.
LEVEL = {SEGMENT: 0, EBML: 0, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1}

#: Bytes of a sample frame in `write`, frames of a laced block, blocks of a cluster; a sample lasts 1/8000 s.
FRAME, LACED, BLOCKS, SAMPLE_RATE = 576, 8, 32, 8000
PAD = b"\xff"


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, length) of the variable-length integer at `at`; an unknown size is -1."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("bad variable-length integer")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def size_vint(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(kind: int, value: int, width: int = 0) -> bytes:
    return element(kind, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    size: int
    key: bool
    cluster: int
    block: int
    lace: int
    cued: bool


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first starts; kind 0: none, 1: Xiph, 2: fixed, 3: EBML."""
    if kind == 0:
        return [end - at], at
    count = data[at] + 1
    at += 1
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("bad fixed lacing")
        return [each] * count, at
    sizes: list[int] = []
    if kind == 1:
        while len(sizes) < count - 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif count > 1:
        first, n = vint(data, at)
        sizes, at = [first], at + n
        while len(sizes) < count - 1:
            raw, n = vint(data, at)
            value = (1 << 7 * n) - 1 if raw == -1 else raw
            sizes.append(sizes[-1] + value - ((1 << 7 * n - 1) - 1))
            at += n
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("bad lacing")
    return [*sizes, last], at


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its body starts, where it ends) of all elements, masters before what they hold."""
    ends = [(len(data) if end is None else end, -1)]
    while True:
        while len(ends) > 1 and at >= ends[-1][0]:
            ends.pop()
        if at >= ends[0][0]:
            return
        kind, a = vint(data, at, True)
        size, b = vint(data, at + a)
        level = LEVEL.get(kind)
        while len(ends) > 1 and ends[-1][1] >= 0 and level is not None and level <= ends[-1][1]:
            ends.pop()
        body = at + a + b
        stop = ends[-1][0] if size < 0 else body + size
        if stop > ends[-1][0]:
            raise ValueError("an element passes its parent's end")
        yield kind, at, body, stop
        if kind in MASTERS:
            ends.append((stop, LEVEL.get(kind, -1) if size < 0 else -1))
            at = body
        else:
            at = stop


def parse(data: bytes | None, strict: bool = False) -> list[Packet]:
    """The packets in stored order; damage ends the list, or raises if `strict`."""
    out: list[Packet] = []
    if not data:
        return out
    scale, segment, cluster, base, block, group = 1_000_000, 0, 0, 0, -1, None
    lasting: dict[int, int] = {}
    track, cue_track, cues = 0, 0, set()
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for kind, at, body, end in elements(data):
            if kind == SIMPLE_BLOCK or kind == BLOCK:
                block += 1
                where, n = vint(data, body)
                offset, flags = struct.unpack_from(">hB", data, body + n)
                sizes, first = lace_sizes(data, body + n + 3, end, flags >> 1 & 3)
                key = bool(flags & 0x80) if kind == SIMPLE_BLOCK else True
                step = lasting.get(where, 0)
                for i, size in enumerate(sizes):
                    out.append(Packet(where, (base + offset) * scale + i * step, first, size, key, cluster, block, i, False))
                    first += size
                group = len(out) - len(sizes)
            elif kind == TIMESTAMP:
                base = uint(body, end)
            elif kind == CLUSTER:
                cluster = at - segment
            elif kind == REFERENCE and group is not None:
                out[group:] = [p._replace(key=False) for p in out[group:]]
            elif kind == SCALE:
                scale = uint(body, end)
            elif kind == SEGMENT:
                segment = body
            elif kind == NUMBER:
                track = uint(body, end)
            elif kind == 0x23E383:  # a frame's default duration in ns
                lasting[track] = uint(body, end)
            elif kind == CUE_TRACK:
                cue_track = uint(body, end)
            elif kind == CUE_CLUSTER:
                cues.add((cue_track, uint(body, end)))
    except (ValueError, IndexError, struct.error):
        if strict:
            raise
    if cues:
        met: set[tuple[int, int]] = set()
        for i, p in enumerate(out):
            if (c := (p.track, p.cluster)) in cues and c not in met:
                met.add(c)
                out[i] = p._replace(cued=True)
    return out


def write(payload: bytes, uid: int, lacing: int = 3) -> bytes:
    """A file of `payload` as 8-bit PCM, in frames of FRAME bytes; equal payloads and uids make equal files."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    scale = 1_000_000_000 // SAMPLE_RATE  # a tick is a sample
    header = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    info = element(INFO, number(SCALE, scale) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXER, b"millrace") + element(WRITER, b"millrace"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, uid) + number(KIND, 2) + number(LACING, 1) + number(0x23E383, FRAME * scale) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, len(frames), LACED * BLOCKS):
        time, made = c * FRAME, [number(TIMESTAMP, c * FRAME, 8)]
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            some = frames[b : b + LACED]
            kind = lacing if len(some) > 1 else 0
            if b * FRAME - time > 32767:  # the block's own offset has 16 bits
                body.append(cluster := element(CLUSTER, b"".join(made)))
                cues.append((time, at))
                at, time = at + len(cluster), b * FRAME
                made = [number(TIMESTAMP, time, 8)]
            made.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * FRAME - time, 0x80 | kind << 1) + _lace(some, kind) + b"".join(some)))
        body.append(cluster := element(CLUSTER, b"".join(made)))
        cues.append((time, at))
        at += len(cluster)
    points = b"".join(element(CUE_POINT, number(CUE_TIME, t) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, a))) for t, a in cues)
    return header + element(SEGMENT, b"".join(body) + element(CUES, points))


def _lace(frames: list[bytes], kind: int) -> bytes:
    if kind == 0:
        return b""
    sizes = [len(f) for f in frames]
    out = bytes([len(frames) - 1])
    if kind == 1:
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        out += size_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = 1
            while abs(b - a) > (1 << 7 * n - 1) - 1:
                n += 1
            out += (b - a + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return out


PACKETS = "array<struct<track:int,timestamp_ns:long,start:long,size:long,key:boolean,cluster:long,block:int,lace:int,cued:boolean>>"


def packets(blobs: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """A row for each packet of each blob: the id as `id`, and the packet's columns."""
    names = Packet._fields

    @F.pandas_udf(PACKETS)
    def walk(column):
        return column.map(lambda b: [dict(zip(names, p)) for p in parse(b)])

    made = blobs.select(F.col(id_col).alias("id"), walk(F.col(blob_col).cast("binary")).alias("p"))
    return made.select("id", F.explode("p").alias("p")).select("id", "p.*")


def _make(batches: Iterator[pa.RecordBatch], lacing: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        files, sizes = [], np.diff(c.starts)
        for a, b in zip(c.starts[:-1].tolist(), c.starts[1:].tolist()):
            text = c.data[a:b].tobytes()
            text += PAD * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))
            files.append(write(text, 1 + zlib.crc32(text), lacing))
        yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[] for _ in range(6)]
        for blob in batch.column("media"):
            data = blob.as_py()
            found = parse(data, strict=True)
            payload = b"".join([data[p.start : p.start + p.size] for p in found])
            v = np.frombuffer(payload, np.uint8)
            mean = int(v.sum(dtype=np.int64)) * 1000 // len(v)
            cued = sum(p.cued for p in found)
            text = f"packets={len(found)};blocks={found[-1].block + 1};clusters={cued};end_ns={found[-1].timestamp_ns};min={v.min()};max={v.max()};mean_milli={mean}"
            for col, x in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), text)):
                col.append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: int = 3) -> DataFrame:
    """Texts stored as media: doc_id, n_bytes (of the text), media (the file)."""
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _make(it, lacing), "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """From the stored bytes of `media`: payload and file digests, and a feature text of the packets and samples."""
    return stored.mapInArrow(_measure, FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: int = 3) -> DataFrame:
    """`features(media(docs))` in one worker a task, which passes each stored batch on without keeping it."""
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _measure(_make(it, lacing)), FEATURES)
