"""Texts beyond every chunk size, in each operator."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import attribution, bwt_merge, covering_simhash, decontaminate, matroska, packing, patched_frames, repeated_phrases, secret_ledger, toxicity_neighbours
from millrace.llm.common import CHUNK_BYTES
from millrace.llm.tokens import default_path

PASSAGE = " ".join(f"passage{k}" for k in range(60))
SECRET = "password=abcdefgh12345678"


@pytest.fixture(scope="module")
def rows():
    """1 holds 0's passage once early and once at its very end, 2 is a copy of 1, 3 is 1 but for a word in the middle."""
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(420_000)]
    words[1000:1060] = words[-60:] = PASSAGE.split()
    words[200_000] = SECRET
    long = " ".join(words)
    words[250_000] = "edited"
    assert len(long) > (1 << 22) > CHUNK_BYTES
    return [(0, f"first {PASSAGE} last"), (1, long), (2, long), (3, " ".join(words))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_substring_dedups(docs, rows):
    got = {r["doc_id"]: r for r in repeated_phrases.dedup(docs).collect()}
    n = len(rows[1][1].split())
    assert [got[i]["n_words"] for i in range(4)] == [62, n, n, n]
    # of 3 only what lies around the edited word stays
    assert [got[i]["n_removed"] for i in range(4)] == [0, 120, n, n - 1]
    assert got[3]["kept_sha256"] == hashlib.sha256(b"edited").hexdigest()
    got = {r["doc_id"]: r for r in bwt_merge.dedup(docs).collect()}
    size = len(rows[1][1])
    assert got[0]["n_removed"] == 0 and got[2]["n_removed"] == size and got[2]["n_spans"] == 1
    # the passage with the space before it, once with the one after it too
    assert got[1]["n_removed"] == 2 * len(PASSAGE) + 3 and got[1]["n_spans"] == 2
    at = rows[3][1].index(" edited ")
    old = rows[1][1]
    same = next(k for k in range(99) if rows[3][1][at + 1 + k] != old[at + 1 + k]) if rows[3][1][at + 1] == old[at + 1] else 0
    assert got[3]["n_spans"] == 2 and len(rows[3][1]) - got[3]["n_removed"] <= len("edited") - same


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r["doc_id"]: r for r in patched_frames.read(patched_frames.write(docs)).collect()}
    assert {i: (r["n_tokens"], r["ids_crc32"]) for i, r in got.items()} == {i: (len(v), crc(v)) for i, v in want.items()}
    pieces = defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, v in want.items():
        assert sorted(pieces[i])[-1][0] + sorted(pieces[i])[-1][1] == len(v)
        assert all(crc(v[a : a + n]) == c for a, n, c in pieces[i])
    counts = defaultdict(float)
    for r in attribution.attribute(docs).collect():
        counts[r["doc_id"]] += r["n_tokens"]
    assert counts == {i: len(v) - 1 for i, v in want.items()}


def test_search_and_media(spark, docs, rows):
    spans = {r["doc_id"]: r["spans"] for r in secret_ledger.digest(secret_ledger.scan_versions(docs)[0]).collect()}
    place = [x.find(SECRET) for _, x in rows]
    assert [spans[i] for i in range(4)] == ["", *(f"assign:{p}:{p + len(SECRET)}" for p in place[1:])]
    item = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_shared"]) for r in decontaminate.search(docs, item).collect()) == [(i, 56) for i in range(4)]
    assert decontaminate.keep_uncontaminated(docs, item).count() == 0
    got = {r["doc_id"]: r for r in matroska.media_features(docs).collect()}
    for i, x in rows:
        p = x.encode() + b"\xff" * (-len(x.encode()) % 576)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"]) == (len(x.encode()), hashlib.sha256(p).hexdigest())


def test_near_copies_and_scores(spark, docs, rows):
    got = {r["doc_id"]: r["component_id"] for r in covering_simhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}
    assert {r["doc_id"] for r in covering_simhash.keep_one(docs).collect()} == {0, 1}
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(40)], "doc_id long, toxic int")
    examples = spark.createDataFrame([(10 + k, f"rude words {PASSAGE}" if k % 2 else f"kind w{k}") for k in range(40)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity_neighbours.score(docs, toxicity_neighbours.fit(examples, labels)).collect()}
    assert min(scores.values()) > 0.9
