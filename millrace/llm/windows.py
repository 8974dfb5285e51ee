"""Fixed-length windows over sequences: hashes, and the minimizer that a window has wherever its content occurs.

Hashes of grams are polynomials modulo 2**64 over random element values, from prefix sums, then mixed. They only say where
to look: over an odd base such polynomials collide by construction from some hundred elements on, so grams are short and
whoever calls two things equal compares them. Words and other long runs of bytes are hashed eight bytes at a time
(`span_hashes`) and compared likewise (`equal_spans`). The minimizer of a window is the place of its gram with the least
hash, the last of equals; equal windows have it at the same place, so grouping minimizers' grams brings equal windows
together with one gram for about every (w + 1) / 2 elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Fixed random odd values, one for each byte.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes from which on a span is hashed and compared by itself; masks of the first 0 to 8 bytes of a number.
LONG = 512
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64, kept and grown by doubling."""
    p = _powers.get(base)
    if p is None or len(p) <= n:
        p = np.ones(1, np.uint64) if p is None else p
        while len(p) <= n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _powers[base] = p
    return p[: n + 1]


def mix(x: np.ndarray, key: int = 0) -> np.ndarray:
    x = x ^ np.uint64(key) if key else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), BASE)[:-1], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the elements [start, end)."""
    return (sums[ends] - sums[starts]) * powers(len(sums) - 1, _INVERSE)[starts]


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hashes of all runs of n elements."""
    count = max(0, len(sums) - n)
    return (sums[n : n + count] - sums[:count]) * powers(len(sums) - 1, _INVERSE)[:count]


def minimizers(order: np.ndarray, w: int, block: int = 1 << 22) -> np.ndarray:
    """For each run of w grams the place of its least by the upper 40 bits of `order`, the last of equals."""
    n = len(order) - w + 1
    out = np.empty(max(0, n), np.int64)
    for b in range(0, n, block):
        part = order[b : min(b + block, n) + w - 1]
        m = len(part)
        low = np.uint64((1 << 24) - 1) - np.arange(m, dtype=np.uint64)
        v, size = (part & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | low, 1
        while 2 * size <= w:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < w:
            v = np.minimum(v[: size - w], v[w - size :])
        out[b : b + len(v)] = b + (np.uint64((1 << 24) - 1) - (v & np.uint64((1 << 24) - 1))).astype(np.int64)
    return out


def words(data: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word: maximal runs without `space`, ASCII white space, cut at documents' ends."""
    inside = ~space[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = starts[1:-1]
    before[edge[edge < len(data)]] = False
    after[edge[edge > 0] - 1] = False
    a, b = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return a, b, np.searchsorted(starts, a, "right") - 1


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end. A view if `data` ends with eight spare ones."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _steps(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(which spans are longer than `at`, masks of their next eight bytes, at), for spans up to LONG."""
    live, at = np.flatnonzero((sizes > 0) & (sizes <= LONG)), 0
    while len(live):
        yield live, MASKS[np.minimum(sizes[live] - at, 8)], at
        at += 8
        live = live[sizes[live] > at]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of the bytes of each span, eight of them at a time; long spans by XXH3."""
    import xxhash

    sizes, v = ends - starts, loads(data)
    h = mix(sizes.astype(np.uint64), key ^ 0x5851F42D4C957F2D)
    for live, mask, at in _steps(sizes):
        h[live] = mix(h[live] ^ (v[starts[live] + at] & mask))
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], key)
    return h


def equal_spans(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, c: np.ndarray, d: np.ndarray, vx: np.ndarray | None = None, vy: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes x[a:b] are y[c:d], span by span; vx and vy are their `loads`, if there are some already."""
    vx, vy = loads(x) if vx is None else vx, loads(y) if vy is None else vy
    sizes = b - a
    out = sizes == d - c
    for live, mask, at in _steps(np.where(out, sizes, 0)):
        differ = (vx[a[live] + at] ^ vy[c[live] + at]) & mask != 0
        out[live[differ]] = False
    for i in np.flatnonzero(out & (sizes > LONG)).tolist():
        out[i] = np.array_equal(x[a[i] : b[i]], y[c[i] : d[i]])
    return out


def word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return span_hashes(data, a, b, 71)


def runs(flags: np.ndarray, *changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of true flags, over which none of `changes` changes."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(len(flags), bool)
    for c in changes:
        new[1:] |= c[1:] != c[:-1]
    left = np.concatenate([[False], flags[:-1]])
    right = np.concatenate([flags[1:], [False]])
    newer = np.concatenate([new[1:], [True]])
    return np.flatnonzero(flags & (~left | new)), np.flatnonzero(flags & (~right | newer)) + 1


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the n places that some [start, end) covers."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0
