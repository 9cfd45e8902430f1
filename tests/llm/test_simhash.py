import random

import xxhash
from talkweave.llm import simhash


def plain(text):
    words = []
    for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: " " for c in range(9, 14)}).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] % (1 << 64) == plain(t)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    r = random.Random(1)
    for _ in range(20_000):
        diff = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not diff & m for m in masks)


def test_links_equal_brute_force(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(150)} | {0}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 4)))
            fps.add(f)
    dense = r.getrandbits(64)
    fps |= {dense ^ sum(1 << b for b in r.sample(range(20), r.randrange(0, 9))) for _ in range(400)}
    ids = sorted(simhash._signed(f) for f in fps)
    want = closure(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3])
    df = spark.createDataFrame([(i,) for i in ids], "fp long")
    assert {x.id: x.component for x in simhash.link_fingerprints(df).collect()} == want
    assert {x.id: x.component for x in simhash.link_fingerprints(df, block=16).collect()} == want


def test_documents(docs, no_docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    n = len(texts)
    assert [got[n - 4 + k].component_id for k in range(4)] == [got[5 + k].component_id for k in range(4)]
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept - {None} == {i for i, r in got.items() if r.component_id == i} - {None}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("first " * 9 + str(i) for i in range(3))
    unlike = "quite another text of some words, under an id that is used already"
    rows = [(0, a, 1), (1, a, 2), (1, unlike, 3), (1, unlike, 4), (None, a, 5), (None, None, 6), (None, "", 7), (5, c, 8), (5, b, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, r1 int").withColumnRenamed("r1", "fp")
    fp = {t: simhash.simhash(t) for _, t, _ in rows}
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    # whatever links, one row of each component is left
    texts = list(fp)
    root = closure(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (fp[texts[i]] ^ fp[texts[j]]).bit_count() <= 3])
    assert len(kept) == len(set(root.values())) and {root[texts.index(t)] for _, t in kept} == set(root.values())
    assert (0, a) in kept and (1, unlike) in kept
