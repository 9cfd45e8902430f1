"""op3's order, windows and long runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkweave.llm import embedding_dedup as ed


def at_cosine(r, x, cosine):
    """A unit vector at exactly this cosine of each row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("dense", [False, True])
def test_recall_at_the_threshold_with_production_parameters(spark, dense):
    r = np.random.default_rng(5 + dense)
    n = 4000
    x = r.standard_normal((n, 64))
    if dense:  # a third of all in one region, few of them linked with each other
        x[: n // 3] = at_cosine(r, np.repeat(r.standard_normal((1, 64)), n // 3, 0), 0.9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = at_cosine(r, x[::4], 0.9501)
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>").repartition(6)
    got = {q.vec_id: q for q in ed.near_duplicate_vectors(df).collect()}
    near = both @ both.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    pairs = [(4 * k, n + k) for k in range(len(y))]
    found = sum(got[a].component_id == got[b].component_id for a, b in pairs)
    assert found >= 0.99 * len(pairs)
    # no false link: components are never larger than true ones, and counts inside them are exact
    label = np.arange(len(both))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(both)).min(1))
        if (new == label).all():
            break
        label = new
    assert all(label[q.component_id] == label[i] for i, q in got.items()) and all(q.n_links <= want[i] for i, q in got.items())
    assert sum(q.n_links for q in got.values()) >= 0.99 * want.sum()


def test_order_and_ranks(spark):
    keys = spark.createDataFrame([(8, p, (k * 37) % 101, k) for p in (1, 0) for k in range(101)], "dim int, pass int, key long, rep long").repartition(7)
    ranked, _ = ed._numbered(keys)
    got = [(q["pass"], q["key"]) for q in ranked.orderBy("rank").collect()]
    assert got == sorted(got) and [q.rank for q in ranked.orderBy("rank").collect()] == list(range(202))


@pytest.mark.parametrize("rows_per_task", [8, 11, 1000])
def test_windows_reach_over_blocks(spark, rows_per_task):
    """Neighbours up to the window apart are linked, whatever blocks they are in, and none farther apart."""
    r, window = np.random.default_rng(1), 4
    base = r.standard_normal((12, 6))
    v = np.concatenate([base, base[:6] * 2, base[6:] * 3])  # k is parallel to k + 12 alone
    for apart, linked in ((4, True), (5, False)):
        order = [*range(12)]
        place = {k: i for i, k in enumerate(order)} | {k + 12: i + apart - 0.5 + 1e-3 * i for i, k in enumerate(order)}
        ranks = sorted(place, key=place.get)
        rows = [(i, k) for i, k in enumerate(ranks)]
        distance = {k: abs(ranks.index(k) - ranks.index(k + 12)) for k in range(12)}
        parts = []
        for i, k in rows:
            for block in {i // rows_per_task, (i + window) // rows_per_task}:
                parts.append((block, i, 6, 0, k, v[k].astype("<f8").tobytes()))
        frame = pd.DataFrame(sorted(parts), columns=["block", "rank", "dim", "pass", "rep", "v"])
        got = set()
        for out in ed.window_links(0.999999, "<f8", window)(iter([frame.iloc[:7], frame.iloc[7:]])):
            got |= {tuple(sorted(map(int, p))) for p in out.itertuples(index=False)}
        assert got == {(k, k + 12) for k in range(12) if distance[k] <= window}
        assert linked == bool(got) or apart == 5


def test_long_runs_are_compared_whole(spark):
    r = np.random.default_rng(3)
    chain = np.cumsum(r.standard_normal((150, 24)) * 0.001, 0) + r.standard_normal((1, 24))  # all nearly parallel: every prefix is one run
    df = spark.createDataFrame([(i, v) for i, v in enumerate(chain.tolist())], "vec_id long, embedding array<double>")
    got = ed.near_duplicate_vectors(df, window=4, block=16, rows_per_task=32).agg(F.min("n_links").alias("least"), F.countDistinct("component_id").alias("n")).first()
    assert (got.least, got.n) == (149, 1)
