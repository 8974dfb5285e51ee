"""The nearest examples against all cosines, and what the operator learns from planted texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from millrace.llm import toxicity_neighbours as T


def _index(rng, n, terms):
    rows = [(i, int(rng.random() < 0.5), sorted(rng.sample(range(terms), rng.randint(0, 12))), None) for i in range(n)]
    return [(i, y, p, [rng.randint(1, 5) for _ in p]) for i, y, p, _ in rows]


def test_nearest_is_exact():
    rng = random.Random(4)
    rows = _index(rng, 700, 60)
    index = T.build(rows, np.arange(60, dtype=np.uint64))
    df = Counter(p for r in rows for p in r[2])
    idf = [math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in range(60)]
    vec = lambda p, c: {t: (1 + math.log(x)) * idf[t] for t, x in zip(p, c)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for _ in range(60):
        p = sorted(rng.sample(range(60), rng.randint(1, 8)))
        c = [rng.randint(1, 4) for _ in p]
        q = vec(p, c)
        want = []
        for i, _, ep, ec in rows:
            v = vec(ep, ec)
            dot = sum(x * v.get(t, 0) for t, x in q.items())
            if dot:
                want.append(dot / norm(q) / norm(v))
        best, sims = index.nearest(np.array(p), np.array(c))
        np.testing.assert_allclose(sims, sorted(want, reverse=True)[: T.K], atol=1e-9)
        for e, s in zip(best, sims):
            i = int(index.ids[e])
            v = vec(*rows[i][2:])
            assert abs(sum(x * v.get(t, 0) for t, x in q.items()) / norm(q) / norm(v) - s) < 1e-9


def _texts(n):
    rng = random.Random(9)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 60))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), "grubling" + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words) if words else None, "x", i))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_scores(spark):
    rows, labels = _texts(600)
    docs = spark.createDataFrame(rows + [(None, "a GRUBLING here", "y", 0), (1000, "", "y", 0), (0, rows[0][1], "again", 0)], "doc_id long, text string, score string, toxic int")
    known = spark.createDataFrame(labels + [(None, 1, 1), (2000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.score(docs, T.fit(docs, known)).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in labels)
    assert got[None]["score"] >= 0.5 and got[1000]["score"] < 0.5
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", T.held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    kept = T.keep_clean(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, y in labels if not y] + [1000]


def test_without_examples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in T.score(docs, T.fit(docs, none)).collect()] == [0, 0]
    assert T.score(docs.limit(0), T.fit(docs, none)).count() == 0


def test_blocks_that_are_skipped_change_nothing(monkeypatch):
    rng = random.Random(14)
    rows = _index(rng, 900, 40)
    terms, weigh = np.arange(40, dtype=np.uint64), np.array([rng.random() ** 4 for _ in range(40)])
    index = T.build(rows, terms, weigh)
    monkeypatch.setattr(T, "RARE", 48)
    assert index.layout.dense.shape[1] > 10 and len(index.layout.value) == 0
    few = T.build([(i, y, [t for t in p if t < 20 or i < 90], [c for t, c in zip(p, x) if t < 20 or i < 90]) for i, y, p, x in rows], terms, weigh)
    assert few.layout.dense.shape[1] and len(few.layout.value)
    for ix in (index, few):
        full = np.zeros((len(ix.toxic), 40))
        term, example, value = ix.postings
        full[example, term] = value
        for _ in range(40):
            p = np.array(sorted(rng.sample(range(40), rng.randint(1, 9))))
            c = np.array([rng.randint(1, 4) for _ in p])
            w = (1 + np.log(c)) * ix.weight[p]
            cos = full[:, p] @ (w / np.sqrt((w * w).sum()))
            want = np.lexsort((np.arange(len(cos)), -np.round(cos, 9)))[: T.K]
            want = want[cos[want] > 0]
            best, sims = ix.nearest(p, c)
            assert best.tolist() == want.tolist()
            np.testing.assert_allclose(sims, cos[want], atol=1e-9)


def test_isotonic():
    rng = np.random.default_rng(3)
    x, w = rng.random(300), rng.integers(1, 4, 300).astype(float)
    y = (rng.random(300) < x).astype(float)
    at, value = T.isotonic(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    # the value of a place is the greatest of the least means of the ranges around it
    order = np.argsort(x, kind="stable")
    best = [max(min(np.average(y[order][a:b], weights=w[order][a:b]) for b in range(i + 1, len(x) + 1)) for a in range(i + 1)) for i in range(0, len(x), 37)]
    assert all(min(abs(b - v) for v in value) < 1e-9 for b in best)


def _noisy(n, seed):
    """Texts of a topic each; a toxic one has one to three of 40 rude words, a clean one rarely has one; labels are noisy."""
    rng = random.Random(seed)
    rude = [f"rude{k}" for k in range(40)]
    rows, labels, truth = [], [], {}
    for i in range(n):
        topic = rng.randint(0, 20)
        words = [f"t{topic}w{rng.randint(0, 60)}" if rng.random() < 0.7 else f"c{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 3) if toxic else rng.random() < 0.01):
            words.insert(rng.randint(0, len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        truth[i] = int(toxic)
        labels.append((i, int(toxic) if rng.random() > 0.01 else int(not toxic)))
    return rows, labels, truth


def test_held_out_ranking_recall_and_calibration(spark):
    rows, labels, truth = _noisy(3000, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in T.score(docs, T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    ones, zeros = ([got[i]["score"] for i in held if truth[i] == y] for y in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros)
    assert auc >= 0.97
    assert sum(a >= 0.5 for a in ones) >= 0.9 * len(ones) and sum(b >= 0.5 for b in zeros) <= 0.02 * len(zeros)
    for low, high in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):
        some = [(got[i]["score"], truth[i]) for i in held if low <= got[i]["score"] < high]
        if len(some) > 20:
            assert abs(sum(s for s, _ in some) - sum(y for _, y in some)) / len(some) < 0.08
    assert all(r["evidence"] for r in got.values())
    # no example votes for its own text
    assert all(i not in got[i]["evidence"] for i in got)


def test_a_sample_of_examples_keeps_the_scale(spark):
    """With fewer clean examples than labelled rows, scores still follow the share of toxic rows among all."""
    rows, labels, truth = _noisy(2500, 6)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r["score"] for r in T.score(docs, T.fit(docs, known, examples=250)).collect()]
    assert abs(sum(got) / len(got) - sum(truth.values()) / len(truth)) < 0.04
