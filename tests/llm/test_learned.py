import random
import zlib

import numpy as np
import pandas as pd
from talkweave.llm import embedding_dedup, langid, quality

from .test_simhash import closure


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((400, 16))
    hot = r.standard_normal(16)
    rows = [*base, *(base[:80] + 0.05 * r.standard_normal((80, 16))), *(hot + 0.12 * r.standard_normal((500, 16))), *(base[:5] * 3), *base[:7], *[hot] * 40]
    x = np.array(rows, "f4")
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0]]
    data = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(10_000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'a' as rep", "1 as component").repartition(3)
    got = {q.vec_id: q for q in embedding_dedup.near_duplicate_vectors(df, window=16, block=64).collect()}
    assert len(got) == len(data)
    u = x.astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n = near.sum(1)
    root = closure(range(len(x)), zip(*(k.tolist() for k in np.nonzero(near))))
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == [root[i] for i in range(len(x))]
    assert all(got[10_000 + k].n_links == 0 and got[10_000 + k].component_id == 10_000 + k for k in range(6))
    assert got[10_006].n_links == got[10_007].n_links == 1 and got[10_007].component_id == 10_006
    assert all(q.kept == (q.vec_id == q.component_id) for q in got.values())
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.01]
    rows = [(1, a), (1, b), (2, a), (None, c), (None, [0.0, 0.0, 1.0]), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(q.vec_id, q.n_links, q.component_id, q.kept) for q in embedding_dedup.near_duplicate_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, False), (7, 0, 7, True)]))


def test_pairs_in_a_dense_cluster_are_found(spark):
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    # 2,000 vectors at mutual cosine 0.9, below the threshold, and 200 partners at 0.955 of some of them
    hot = unit(np.sqrt(0.9) * unit(r.standard_normal(256)) + np.sqrt(0.1) * unit(r.standard_normal((2000, 256))))
    off = r.standard_normal((200, 256))
    off = unit(off - (off * hot[:200]).sum(1, keepdims=True) * hot[:200])
    pair = 0.955 * hot[:200] + np.sqrt(1 - 0.955**2) * off
    x = np.concatenate([hot, pair, unit(r.standard_normal((3800, 256)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {q.vec_id: q.component_id for q in embedding_dedup.near_duplicate_vectors(df, window=16, block=64).collect()}
    assert [i for i in range(200) if got[i] != got[2000 + i]] == []


def words(r, stock, n):
    return " ".join(r.choice(stock) for _ in range(n))


def test_languages(spark, no_docs):
    r = random.Random(6)
    stock = {"aa": ["the", "thing", "of", "and", "with"], "bb": ["le", "chose", "été", "une", "avec"], "cc": ["der", "ding", "über", "und", "nicht"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(stock))
        rows.append((i, words(r, stock[lang], r.randrange(2, 60)), lang))
    rows += [(700, None, "aa"), (701, "", "aa"), (702, "123 !!", "bb"), (703, "thing", None), (None, "über und", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as k", "2 as t")
    model = langid.train(df, buckets=1 << 12)
    got = {q.doc_id: q for q in langid.predict(df, model).collect()}
    test = [(i, lang) for i, _, lang in rows[:600] if held(i)]
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) > 0.97
    assert [got[i].lang_pred for i in (700, 701, 702)] == ["und"] * 3 and got[703].lang_pred == "aa" and got[None].lang_pred == "cc"
    assert all(0 <= q.score <= 1 for q in got.values()) and 0.02 <= model.temperature <= 20
    assert (model.weights == 0).mean() > 0.3
    empty = langid.train(df.limit(0), buckets=1 << 12)
    assert langid.predict(df.limit(0), empty).collect() == []
    assert {q.lang_pred for q in langid.predict(df, empty).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    r = random.Random(8)
    rows = [(i, words(r, ["the", "thing", "of"], 20), "aa") for i in range(900)] + [(1000 + i, words(r, ["le", "chose", "avec"], 20), "bb") for i in range(12)]
    rows += [(2000 + i, "the thing of", "aa") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = df.selectExpr("text as t", "lang as y")
    sample = langid.language_sample(known, 50).toPandas()
    assert (sample["y"] == "aa").sum() == 50 and (sample["y"] == "bb").sum() == 12 and sample["t"].is_unique
    model = langid.train(df, buckets=1 << 12, most_docs=50)
    got = {q.doc_id: q.lang_pred for q in langid.predict(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows if held(i))


def test_ngram_counts_in_blocks(monkeypatch):
    whole = langid.ngram_counts("abcdefghij klm" * 9, 1 << 10)
    monkeypatch.setattr(langid, "_BLOCK", 10)
    assert (langid.ngram_counts("abcdefghij klm" * 9, 1 << 10) == whole).all()


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    u, pair = r.standard_normal(11), r.standard_normal((2, 2))
    p, expected = quality.marginals(u, counts, pair)
    want, pairs, a = [], np.zeros((2, 2)), 0
    for n in counts:
        z, good, e = 0, np.zeros(n), np.zeros((2, 2))
        for s in np.ndindex(*[2] * n):
            w = np.exp(sum(u[a + t] * s[t] for t in range(n)) + sum(pair[s[t], s[t + 1]] for t in range(n - 1)))
            z += w
            good += w * np.array(s)
            for t in range(n - 1):
                e[s[t], s[t + 1]] += w
        want += list(good / z)
        pairs += e / z
        a += n
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_quality(spark):
    r = random.Random(2)
    fine = ["stone", "river", "walked", "under", "a", "bright", "morning", "sky"]
    rows, labels = [], []
    for i in range(500):
        lines = [words(r, fine, r.randrange(4, 14)).capitalize() + "." for _ in range(r.randrange(1, 8))]
        bad = r.random() < 0.3
        if bad:
            lines[r.randrange(len(lines)) :] = ["BUY!!! $$$ NOW!!! " * 6] * 3
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    rows += [(600, None), (601, ""), (None, "A fine river."), (602, "x" * 50_000)]
    labels += [(None, 1, 0), (3, None, 0), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as y", "'q' as quality")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    model = quality.train(docs, marks.select("doc_id", "quality"), most_per_class=200)
    got = {q.doc_id: q.score for q in quality.score(docs, model).collect()}
    test = [(i, y) for i, y, _ in labels[:500] if held(i)]
    assert np.mean([(got[i] >= 0.5) == y for i, y in test]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    # a smaller sample of the frequent class moves the cut no further than chance
    few = quality.train(docs, marks.select("doc_id", "quality"), most_per_class=60)
    share = [np.mean([s >= 0.5 for s in scores]) for scores in (got.values(), quality.score_all(few, [t or "" for _, t in rows]))]
    assert abs(share[0] - share[1]) < 0.08
    kept = quality.keep_good(docs, marks.select("doc_id", "quality"))
    assert kept.columns == docs.columns and 250 < kept.count() < 450
    none = quality.train(docs.limit(0), marks.limit(0))
    assert quality.score(docs.limit(0), none).collect() == []
    assert isinstance(quality.score_all(none, ["a", ""]), np.ndarray) and pd.notna(quality.score_all(none, [""])).all()


def test_a_language_of_long_texts_alone_is_learned(spark):
    r = random.Random(1)
    rows = [(i, words(r, ["the", "of", "and", "house", "they"], 60), "en") for i in range(60)]
    rows += [(100 + i, words(r, ["zzik", "zwar", "wzok", "ozzy"], 15_000), "zz") for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1 << 24, 40):  # counts for all texts; for the first one of each language only
        m = langid.train(df, most_entries=most)
        assert m.labels == ["en", "zz"]
        got = {q.doc_id: q.lang_pred for q in langid.predict(df, m).collect()}
        assert all(got[i] == lang for i, _, lang in rows)
