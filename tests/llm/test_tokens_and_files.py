"""Encoding, packing, patched frames and attribution against brute force."""

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import attribution, matroska, packing, patched_frames
from millrace.llm.tokens import Encoder, default_path

TEXTS = [None, "", "a", "two words", " lead", "trail ", "tab\there", "line\nline\n\nx", "é ñ 漢字 漢", "<|endoftext|> a", "long " * 3000, "wörd, then. " * 900, "two words", "x" * 5000, "\n", "a  b"]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"extra{i}", i) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, "two words", "again", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int"), rows


def test_pieces_encode_as_whole_texts(tok):
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(" \n\tab'é1.,") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    e = Encoder(default_path(), memory=50)
    assert e.encode(pa.array(texts), group=500) == [np.array(tok(t)[:-1], np.uint16).tobytes() for t in texts]


def _twins(n):
    """Two words of n letters (a power of two) whose polynomials modulo 2**64 over any odd base are equal from 1024 on."""
    one = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in one), "".join("ba"[x] for x in one)


def test_pieces_of_equal_hash(tok):
    texts = [f"{a} x {b}" for n in (1024, 4096) for a, b in (_twins(n), _twins(n)[::-1])] + [t or "" for t in TEXTS]
    want = [np.array(tok(t)[:-1], np.uint16).tobytes() for t in texts]
    e = Encoder(default_path())
    assert e.encode(pa.array(texts)) == want
    assert [e.encode(pa.array([t]))[0] for t in texts] == want
    e = Encoder(default_path())
    e._hash = lambda data, s, e: (e - s).astype(np.uint64)  # every two pieces of one length share a hash
    assert e.encode(pa.array(texts)) == want
    assert [e.encode(pa.array([t]))[0] for t in texts] == want


def test_twins_in_the_operators(spark, tok):
    rows = [(2 * i + k, t) for i, n in enumerate((1024, 4096)) for k, t in enumerate(_twins(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    _check_pack(packing.pack(docs).collect(), rows, tok, 2048)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in patched_frames.read(patched_frames.write(docs)).collect()}
    assert got == {i: (len(tok(t)), zlib.crc32(np.array(tok(t), "<u4").tobytes())) for i, t in rows}
    got = {r["doc_id"]: r["n_tokens"] for r in attribution.attribute(docs).collect()}
    assert got == {i: len(tok(t)) - 1 for i, t in rows}


def test_very_long_texts(tok):
    rng = random.Random(6)
    words = ["alpha", "beta,", "(gamma)", "d'elta", "é漢", "x" * 40, "1234.5"]
    long = " ".join(rng.choice(words) for _ in range(700_000))
    assert len(long) > 1 << 22
    bare = "ab" * 1_100_000 + "c d"  # hardly a place to cut
    e = Encoder(default_path())
    for t in (long, long[: (1 << 22) + 10] + " ", bare):
        assert e.encode(pa.array([t]))[0] == np.array(tok(t)[:-1], np.uint16).tobytes()


def _check_pack(got, rows, tok, capacity):
    want = Counter()
    for i, t, *_ in rows:
        ids = tok(t)
        first = len(ids) % capacity or capacity
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 else capacity
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter(tuple(r[:5]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_pack(spark, docs, tok):
    df, rows = docs
    for capacity in (7, 100, 2048):
        got = packing.pack(df, capacity=capacity).collect()
        n = _check_pack(got, rows, tok, capacity)
        assert n >= -(-sum(len(tok(t)) for _, t, *_ in rows) // capacity)
    assert packing.pack(df.limit(0)).count() == 0


def _best(sizes, capacity):
    """Least number of bins, by trying."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b + sizes[i]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_plan_uses_each_piece_once_and_few_bins():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice((10, 17, 30))
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        p = packing.plan(Counter(sizes), capacity)
        used = Counter()
        for n, lengths in p.runs:
            assert sum(lengths) <= capacity
            for s in lengths:
                used[s] += n
        assert used == Counter(sizes)
        assert p.bins <= _best(sizes, capacity) + 1
        if p.fixed == p.bins:  # the reduction alone is optimal
            assert p.bins == _best(sizes, capacity)


def test_reduction_by_sets_of_three(monkeypatch):
    log = []
    plain = packing.Plan.add
    monkeypatch.setattr(packing.Plan, "add", lambda self, times, lengths, fixed=False: (log.append((times, lengths, fixed)), plain(self, times, lengths, fixed))[1])
    rng = random.Random(33)
    alone = three = 0
    for _ in range(1500):
        capacity, low = rng.choice((20, 50, 100)), rng.choice((0.12, 0.2, 0.26))
        sizes = sorted((rng.randint(max(1, int(low * capacity)), int(0.7 * capacity)) for _ in range(rng.randint(3, 9))), reverse=True)
        log.clear()
        p, best = packing.plan(Counter(sizes), capacity), _best(sizes, capacity)
        assert p.bins <= best + 1
        if p.fixed == p.bins:
            alone += 1
            assert p.bins == best
        # Whatever is fixed before best fit begins leaves an optimal packing of the rest.
        rest, n = Counter(sizes), 0
        for times, lengths, fixed in log:
            if not fixed:
                break
            three += times * (len(lengths) == 3)
            for _ in range(times):
                rest -= Counter(lengths)
                n += 1
            assert n + (_best(sorted(rest.elements(), reverse=True), capacity) if rest else 0) == best
    assert alone > 700 and three > 30, (alone, three)


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def close(self):
        pass


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 300, 50257, 1 << 32):
            v = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            v[rng.random(n) < 0.02] = (1 << 32) - 1
            f = _File()
            w = patched_frames.Writer(f)
            cuts = np.sort(rng.integers(0, n + 1, 4))
            parts = np.split(v, cuts)
            for i, p in enumerate(parts):
                w.add(i or None, p)
            w.close()
            r = patched_frames.Reader(f)
            assert (np.concatenate([np.empty(0, np.uint32), *[x for _, x in r.runs()]]) == v).all()
            assert (r.tokens(n // 3, n // 2) == v[n // 3 : n // 2]).all()
            assert np.diff(r.starts).tolist() == [len(p) for p in parts]


def test_files(spark, docs, tok):
    df, rows = docs
    got = patched_frames.read(patched_frames.write(df, per_file=4096)).collect()
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t, *_ in order:
        ids = tok(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert patched_frames.read(patched_frames.write(df.limit(0))).count() == 0


def test_bounds():
    b = patched_frames.Bounds([3, 7, 7, 7, 9])
    assert b.files == 6
    h = np.array([-(1 << 63), -1, 0, (1 << 63) - 1])
    assert b.file(np.full(4, 2), h).tolist() == [0] * 4 and b.file(np.full(4, 3), h).tolist() == [1] * 4
    assert b.file(np.full(4, 7), h).tolist() == [2, 3, 3, 4]
    assert b.file(np.full(4, 8), h).tolist() == [4] * 4 and b.file(np.full(4, 9), h).tolist() == [5] * 4
    assert patched_frames.Bounds([]).file(np.array([1, 2]), h[:2]).tolist() == [0, 0]
    # whatever the ids, files ascend with (id, hash)
    rng = np.random.default_rng(8)
    for _ in range(50):
        ids, hashes = rng.integers(-3, 4, 200), rng.integers(-(1 << 63), (1 << 63) - 1, 200)
        bounds = patched_frames.Bounds(rng.choice(ids, rng.integers(0, 12)).tolist())
        order = np.lexsort((hashes, ids))
        file = bounds.file(ids, hashes)
        assert (np.diff(file[order]) >= 0).all() and 0 <= file.min() and file.max() < bounds.files


def test_files_of_one_hot_id(spark, tok):
    """Most rows have no id: they fill several files, in the order of their texts' hashes."""
    import xxhash

    rng = random.Random(9)
    rows = [(None if k % 3 else k - (1 << 60), " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60)))) for k in range(900)]
    rows += [(5, "one text"), (5, "another text"), (5, "one text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    manifest = patched_frames.write(df, per_file=1 << 12)
    files = [r["docs"] for r in manifest.orderBy("file").collect()]
    assert len(files) > 8 and max(files) < 300
    signed = lambda t: (x := xxhash.xxh64_intdigest(t, seed=42)) - (x >> 63 << 64)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = tok(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, patched_frames.read(manifest).collect()), key=lambda r: r[1]) == want


def _sections(tok, text, ends, rule):
    """Tokens by section, from the bytes of each token as the library spells them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    n = len(text.encode())
    section = [sum(b >= e for e in ends) for b in range(n)]
    out, at = [0.0] * len(ends), 0
    for i in t.encode(text, add_special_tokens=False).ids:
        mine = section[at : at + len(t.id_to_token(i))]
        at += len(mine)
        if rule == "first":
            out[mine[0]] += 1
        elif rule == "majority":
            out[max(sorted(set(mine)), key=mine.count)] += 1
        else:
            for s in mine:
                out[s] += 1 / len(mine)
    assert at == n
    return out


@pytest.mark.parametrize("rule", ["first", "majority", "split"])
def test_attribution_by_section(spark, tok, rule):
    import re

    rng = random.Random(12)
    rows = []
    for i in range(60):
        a, b = ("".join(rng.choice(["word", " ", "\n", ".", "é漢", "inging", "  ", "123"]) for _ in range(rng.randint(0, 40))) for _ in range(2))
        rows.append((i, a or None, b))
    df = spark.createDataFrame(rows, "doc_id long, text string, title string")
    got = defaultdict(dict)
    for r in attribution.attribute(df, fields=("title", "text"), boundary="[\n.]|12", rule=rule).collect():
        got[r["doc_id"]][r["section"]] = (r["field"], r["start"], r["end"], r["n_tokens"])
    crossed = 0
    for i, text, title in rows:
        whole = (title + (text or "")).encode()
        # A boundary is matched in the whole document; fields end sections too.
        ends = sorted({m.end() for m in re.finditer(rb"[\n.]|12", whole)} | {len(title.encode()), len(whole)} - {0})
        ends = [e for e in ends if e]
        counts = _sections(tok, whole.decode(), ends, rule) if whole else []
        assert sorted(got[i]) == list(range(len(ends)))
        for s, (begin, end) in enumerate(zip([0, *ends], ends)):
            field, a, b, n = got[i][s]
            assert (a, b) == (len(whole[:begin].decode()), len(whole[:end].decode()))
            assert field == ("title" if begin < len(title.encode()) else "text")
            assert n == pytest.approx(counts[s])
            crossed += n != int(n)
    assert (crossed > 0) == (rule == "split")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert attribution.attribute(none).count() == 0
    assert matroska.media_features(none).count() == 0 and matroska.media(none).count() == 0
    assert matroska.packets(spark.createDataFrame([], "id long, media binary"), "id", "media").count() == 0


@pytest.mark.parametrize("rule", ["first", "majority", "split"])
def test_attribution(spark, docs, tok, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    df, rows = docs
    got = defaultdict(list)
    for r in attribution.attribute(df, fields=("text", "ids"), boundary="[\n.]", rule=rule).collect():
        got[r["doc_id"]].append(tuple(r))
    for i, text, extra, _ in rows:
        if i in (None, 3):
            continue
        whole = (text or "") + (extra or "")
        assert [c for r in sorted(got[i], key=lambda r: r[2]) for c in whole[r[3] : r[4]]] == list(whole)
        assert sum(r[5] for r in got[i]) == pytest.approx(len(t.encode(whole, add_special_tokens=False).ids))
        assert {r[1] for r in got[i]} == ({"text", "ids"} if text else {"ids"})


def test_allocation_rules():
    ends, cuts = np.array([2, 6, 7]), np.array([0, 3, 5, 7])  # the second token has 1, 2 and 1 bytes of the sections
    assert attribution.allocate(ends, cuts, "first")[0].tolist() == [2, 0, 1]
    assert attribution.allocate(ends, cuts, "majority")[0].tolist() == [1, 1, 1]
    assert attribution.allocate(ends, cuts, "split")[0].tolist() == [1.25, 0.5, 1.25]
    assert attribution.allocate(ends, cuts, "split")[1].tolist() == [1, 1, 1]
