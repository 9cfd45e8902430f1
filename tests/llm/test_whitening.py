import numpy as np
import pytest

from talkweave.llm import whitening


def brute(vectors):
    x = np.floor(64 * np.array(vectors, "f8")).astype("i8") + 1_000_000
    n, s = len(x), x.sum(0)
    v = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u, e, v


def test_whitening_equals_eigenvectors(spark):
    r = np.random.default_rng(3)
    good = (r.standard_normal((300, 40)) @ r.standard_normal((40, 40))).astype("f4").tolist()
    bad = [None, good[0][:-1] + [None], good[1][:-1] + [float("nan")], [float("inf")] + good[2][1:], good[3][:9], []]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(1000 + i, v, "y") for i, v in enumerate(bad)] + [(None, good[0], "z"), (5, good[7], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(5)
    n, deviation, projected, e, v = brute([x[1] for x in rows if x[1] in good])
    got = whitening.whiten(df).collect()
    assert len(got) == n * 32 and {g.n for g in got} == {n} and got[0].identity_error < 1e-9
    per = {}
    for g in got:
        per.setdefault((g.vec_id, int(g.deviation)), {})[g.component] = (g.whitened, g.explained)
    ids = list(range(300)) + [None, 5]
    signs = None
    for i, vec_id in enumerate(ids):
        own = per[vec_id, int(deviation[i])]
        w, want = np.array([own[k][0] for k in range(1, 33)]), projected[i][:32] / np.sqrt(e[:32])
        signs = np.sign(w * want) if signs is None else signs
        assert np.allclose(w * signs, want, atol=1e-8)
        assert np.allclose([own[k][1] for k in range(1, 33)], e[:32] / v.trace(), rtol=1e-9)


def test_low_rank_repeats_and_no_rows(spark):
    line = [[float(k), 2.0 * k, -k / 2] for k in range(8)] * 3
    df = spark.createDataFrame([(k, v) for k, v in enumerate(line)], "v int, embedding array<double>")
    got = whitening.whiten(df, "v").collect()
    assert {g.component for g in got} == {1} and len(got) == 24 and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-12
    assert whitening.whiten(df.where("v = 3"), "v").collect() == [] == whitening.whiten(df.limit(0), "v").collect()
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], df.schema)
    assert whitening.whiten(same, "v").columns == ["v", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(same, "v").count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [1e300, 2.0]), (4, [0.25, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    x = [[int(np.floor(np.clip(64 * c, -(2**62), 2**62))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {str(k + 1): sum((4 * c - t) ** 2 for c, t in zip(v, s)) for k, v in enumerate(x)}
    small = {k: w for k, w in want.items() if w < 10**38}
    assert {g.vec_id: g.deviation and int(g.deviation) for g in got} == {k: small.get(k) for k in want}


def test_factor_and_rotation():
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5)):
        b = r.standard_normal((d, rank)) * 10.0 ** r.integers(-3, 4, rank)
        v = b @ b.T
        l, order = whitening.pivoted_cholesky(v)
        assert l.shape == (d, rank) and np.allclose(l, np.tril(l)) and np.allclose(l @ l.T, v[np.ix_(order, order)], atol=1e-9 * v.max())
        a = whitening.one_sided_jacobi(l)
        assert np.allclose(np.sort((a * a).sum(0))[::-1], np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-8, atol=1e-9 * v.max())
    assert whitening.principal_components(np.zeros((3, 3)), 32)[0].shape == (3, 0)
