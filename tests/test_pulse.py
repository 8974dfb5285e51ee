import numpy as np

from millrace.plans import pulse


def test_preprocessing_follows_the_recurrences():
    x = np.random.default_rng(1).integers(0, 50, 300)
    y = np.zeros(300)
    get = lambda a, i: a[i] if i >= 0 else 0
    for n in range(300):
        y[n] = 2 * get(y, n - 1) - get(y, n - 2) + x[n] - 2 * get(x, n - 5) + get(x, n - 10)
    d = np.maximum(0, np.diff(y, prepend=y[:1]))
    np.testing.assert_allclose(pulse.preprocess(x), [d[max(0, n - 31) : n + 1].sum() for n in range(300)], atol=1e-6)


def test_onsets():
    p = np.zeros(400)
    p[10:20] = np.linspace(60, 300, 10)  # accepted
    p[40:45] = np.linspace(60, 300, 5)  # silent
    p[150:160] = 70  # too flat
    p[300:310] = np.linspace(60, 200, 10)
    assert pulse.onsets(p, 50) == [10, 300]


def test_detect(spark):
    beat = lambda n, k: 80 + 20 * max(0.0, np.sin(2 * np.pi * (n - k) / 250))
    rows = [(k, n, float(beat(n, 30 * k))) for k in (0, 1) for n in range(2000)]
    level = float(pulse.preprocess(np.array([r[2] for r in rows if r[0] == 0]))[100:].max() / 3)
    got = pulse.detect(spark.createDataFrame(rows, "k long, n long, v double"), ["k"], "n", "v", level).collect()
    counts = {k: sum(r["k"] == k for r in got) for k in (0, 1)}
    assert all(5 <= c <= 9 for c in counts.values())
