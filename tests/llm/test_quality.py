import random
import zlib

import numpy as np

from tessera.llm.quality import NAMES, accepted, features, fit, fold, op7_quality, scored, shallow_tree, train

from .conftest import DATA, frame, needs_data


def test_features():
    assert features(b"") == tuple([0.0] * (len(NAMES) - 1) + [0.0]) or len(features(b"")) == len(NAMES)
    f = dict(zip(NAMES, features(b"The the the CAT!!\nThe the the CAT!!")))
    assert f["repeated_lines"] == 0.5 and round(f["repeated_words"], 3) == round(2 / 7, 3) and f["loud_share"] == 4 / 35


def test_shallow_tree():
    g, h = np.array([4.0, 4, -4, -4, 9]), np.ones(5)
    out = shallow_tree(g, h)
    assert out[0] == out[1] > 0 > out[2] == out[3] and out[4] > 0


def test_fit_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, size=(4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(float)
    m = fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85
    assert (1, 0) in m.pairs
    assert fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (fit(x[:9], np.ones(9)).score(x) > 0.9).all()


def test_rows(spark):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choices(["the", "house", "walks", "green.", "Under", "river,"], k=rnd.randint(5, 80)))
    bad = lambda: " ".join(w + rnd.choice(["$$$", "%%%", "!!"]) for w in good().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (None, "no id"), (5, "the house"), (902, "word " * 30_000)]
    df = frame(spark, rows).withColumnRenamed("lang", "quality").withColumnRenamed("source", "score_")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    m = train(df, labels)
    got = scored(df, m)
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "quality", "n_chars", "score_"]
    right = [(r.score_ >= 0.5) == (r.doc_id % 3 > 0) for r in got.collect() if r.doc_id is not None and r.doc_id < 300]
    assert sum(right) / len(right) > 0.97
    docs = frame(spark, rows)
    assert accepted(docs, labels).columns == docs.columns
    assert accepted(docs.limit(0), labels).count() == 0 and scored(docs, train(docs, labels.limit(0))).select("score_").distinct().count() == 1
    assert [r[0] for r in spark.createDataFrame([(12,), (None,)], "doc_id bigint").select(fold("doc_id")).collect()] == [zlib.crc32(b"12") % 3, None]


@needs_data
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in op7_quality(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.9


def slow_fit(x, y):
    """Cyclic boosting by the definition: row by row, split by split, cell by cell."""
    import math

    import tessera.llm.quality as q

    sigmoid = lambda f: 1 / (1 + math.exp(-f))
    rate = (sum(y) + 0.5) / (len(y) + 1)
    start = math.log(rate / (1 - rate))
    m = len(x[0])

    def cuts(j, n):
        v = sorted(r[j] for r in x)
        return sorted({v[max(0, math.ceil(k / n * len(v) - 1e-12) - 1)] for k in range(1, n)})

    fine, coarse = [cuts(j, q.BINS) for j in range(m)], [cuts(j, q.PAIR_BINS) for j in range(m)]
    bin_of = lambda c, v: sum(e <= v for e in c)
    f = [start] * len(y)
    tables = [[0.0] * (len(c) + 1) for c in fine]
    for _ in range(q.ROUNDS):
        for j in range(m):
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i, r in enumerate(x):
                p, b = sigmoid(f[i]), bin_of(fine[j], r[j])
                g[b] += y[i] - p
                h[b] += p * (1 - p)
            step = q.shallow_tree(np.array(g), np.array(h))
            for b, s in enumerate(step):
                tables[j][b] += q.RATE * s
            for i, r in enumerate(x):
                f[i] += q.RATE * step[bin_of(fine[j], r[j])]

    def grid(a, b):
        g = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
        h = g.copy()
        for i, r in enumerate(x):
            p, at = sigmoid(f[i]), (bin_of(coarse[a], r[a]), bin_of(coarse[b], r[b]))
            g[at] += y[i] - p
            h[at] += p * (1 - p)
        return q.cross(g, h)

    ranked = sorted(((grid(a, b)[1], a, b) for a in range(m) for b in range(a)), reverse=True)
    pairs = [(a, b) for gain, a, b in ranked[: q.PAIRS] if gain > 0]
    grids = {p: 0.0 for p in pairs}
    for _ in range(q.PAIR_ROUNDS):
        for a, b in pairs:
            step = q.RATE * grid(a, b)[0]
            grids[a, b] = grids[a, b] + step
            for i, r in enumerate(x):
                f[i] += step[bin_of(coarse[a], r[a]), bin_of(coarse[b], r[b])]

    def score(r):
        out = start + sum(t[bin_of(c, v)] for t, c, v in zip(tables, fine, r))
        return sigmoid(out + sum(grids[a, b][bin_of(coarse[a], r[a]), bin_of(coarse[b], r[b])] for a, b in pairs))

    return score


def test_fit_and_score_against_the_definition(monkeypatch):
    import tessera.llm.quality as q

    for name, value in (("ROUNDS", 4), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 8), ("PAIR_BINS", 4)):
        monkeypatch.setattr(q, name, value)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    fast, slow = fit(x, y), slow_fit(x.tolist(), y.tolist())
    new = np.round(rng.normal(size=(60, 3)) * 2, 1)
    assert np.allclose(fast.score(new), [slow(r) for r in new.tolist()]) and np.allclose(fast.score(x), [slow(r) for r in x.tolist()])


def test_splits_are_the_best_ones():
    """Against all ways to cut bins in as many parts: none has a greater gain."""
    import itertools

    import tessera.llm.quality as q

    rng = np.random.default_rng(6)
    for _ in range(20):
        g, h = rng.normal(size=7), rng.uniform(0.5, 2, size=7)
        got = q.shallow_tree(g, h)
        first = max(range(1, 7), key=lambda k: sum(g[p].sum() ** 2 / (h[p].sum() + q.PENALTY) for p in (slice(0, k), slice(k, 7))))
        parts = [list(v) for _, v in itertools.groupby(range(7), key=lambda i: got[i])]
        assert len(parts) <= 3 and any(p[0] == first for p in parts)
        for p in parts:
            assert np.allclose(got[p], g[p].sum() / (h[p].sum() + q.PENALTY))
