import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import fingerprint as fp


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark, docs, no_docs, texts):
    texts = list(texts)
    got = {r.doc_id: r for r in fp.fingerprint_with_edits(docs, tasks=5).collect()}
    assert len(got) == len(texts) + 1
    order = [(i, texts[i] or "") for i in range(len(texts) - 1, -1, -1)] + [(None, "the null id")]
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert abs(r.near_edited - jaccard(a, b)) < (1e-12 if len(a | b) <= fp.K else 0.2)
        assert abs(r.near_next - jaccard(a, c)) < (1e-12 if len(a | c) <= fp.K else 0.2)
        assert r.n_shingles == (pytest.approx(len(a)) if len(a) < fp.K else pytest.approx(len(a), rel=0.4))
        assert r.fingerprint == fp.to_text(fp.sketch(t)) and r.edited_fingerprint == fp.to_text(fp.sketch(edited))
    assert fp.fingerprint_with_edits(no_docs).collect() == []
    one = fp.fingerprint_with_edits(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("The the, THE. it's   ok x"[:13] + "The the, THE").encode()).hexdigest()


def test_ties_and_text_ids(spark):
    rows = [("b", "x y z"), ("b", "x y z"), ("a", "p q"), ("b", "other words"), (None, "n n n n n n"), ("a", "p q")]
    got = fp.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id string, text string"), tasks=3).collect()
    assert sorted((r.doc_id or "", r.n_chars) for r in got) == sorted((i or "", len(t)) for i, t in rows)
    (last,) = [r for r in got if r.doc_id is None]
    h = {t: None for _, t in rows if _ == "b"}
    first = spark.createDataFrame([(t,) for t in h], "t string").orderBy(F.desc(F.xxhash64("t"))).first().t
    assert last.edited_sha256 == hashlib.sha256(("n n n " + first[:5]).encode()).hexdigest()


def test_slices_and_merging():
    r = random.Random(5)
    text = " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(3000))
    whole = fp.sketch(text)
    old, fp._SLICE = fp._SLICE, 7
    try:
        assert (fp.sketch(text) == whole).all() and (fp.sketch("one two") == fp.sketch(" ONE\ttwo\n")).all()
        assert (fp.sketch("x" * 50) == fp._combined(np.array([fp._hash_of[b"x" * 50]], "u8"), 5)).all()
    finally:
        fp._SLICE = old
    words = text.split()
    parts = [fp.sketch(" ".join(words[a : a + 104])) for a in range(0, 2900, 100)] + [fp.sketch(" ".join(words[2900:]))]
    assert (fp.merge(*parts) == whole).all() and (fp.from_text(fp.to_text(whole)) == whole).all()
    assert fp.sketch(None).size == fp.sketch(" \n").size == 0 and fp.resemblance(fp.sketch(""), fp.sketch(None)) == 1.0
    assert fp.resemblance(whole, fp.sketch("")) == 0.0 and fp.containment(fp.sketch(""), whole) == 1.0


def test_estimates():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(9000)]
    for kept in (0.0, 0.3, 0.8, 1.0):
        a, b = " ".join(words[:4000]), " ".join(words[int(4000 * (1 - kept)) : 4000 + int(2000 * (1 - kept))])
        x, y, p, q = shingles(a), shingles(b), fp.sketch(a, 1024), fp.sketch(b, 1024)
        assert fp.resemblance(p, q, 1024) == pytest.approx(jaccard(x, y), abs=0.06)
        assert fp.containment(p, q, 1024) == pytest.approx(len(x & y) / len(x), abs=0.08)
        assert fp.distinct_count(p, 1024) == pytest.approx(len(x), rel=0.12)


def test_repeated_shingles_leave_enough():
    text = ("alpha beta gamma delta epsilon " * 5000) + " ".join(map(str, range(400)))
    hashes = {int(h) for h in fp._combined(np.fromiter(map(fp._hash_of.__getitem__, text.encode().split()), "u8"), 5)}
    assert fp.sketch(text).tolist() == sorted(hashes)[: fp.K]


def test_merging_by_key_and_columns(spark):
    r = random.Random(2)
    parts = [(k, " ".join(r.choice("abcdefg") for _ in range(60))) for k in [1] * 300 + [2] * 3 + [None] * 2]
    df = spark.createDataFrame(parts, "source int, text string").repartition(6).select("source", fp.fingerprint(F.col("text")).alias("fingerprint"))
    got = {x.source: x.fingerprint for x in fp.merged(df, "source", salts=4).collect()}
    for key in (1, 2, None):
        want = fp.merge(*(fp.sketch(t) for k, t in parts if k == key))
        assert got[key] == fp.to_text(want)
    e = spark.createDataFrame([(got[1], got[2])], "a string, b string").select(fp.estimates(F.col("a"), F.col("b")).alias("e")).select("e.*").first()
    assert e.resemblance == fp.resemblance(fp.from_text(got[1]), fp.from_text(got[2])) and e.distinct_a == fp.distinct_count(fp.from_text(got[1]))
