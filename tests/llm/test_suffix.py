import random
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from talkweave.llm import suffix_anchors, suffix_dedup, suffix_sort


def brute_order(t, cap):
    s = sorted(range(len(t)), key=lambda i: tuple(t[i : i + cap]))
    lcp = [0]
    for a, b in zip(s, s[1:]):
        k = 0
        while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return s, lcp


@pytest.mark.parametrize("most", [1 << 20, 37, 10, 3])
def test_order_and_prefixes_equal_brute_force(tmp_path, most):
    r = random.Random(most)
    for k in range(250):
        sigma, cap = r.choice([1, 2, 3, 5, 20]), r.choice([1000, 12])
        t = [r.randrange(1, sigma + 1) for _ in range(r.randrange(0, 120))]
        t = np.array([*(t * r.choice([1, 1, 3])), 0], "u1")
        folder = tmp_path / str(k)
        folder.mkdir()
        out = list(suffix_sort.suffix_order(t, cap, str(folder), most, most))
        order, lcp = brute_order(t.tolist(), cap)
        assert np.concatenate([x for _, x in out]).tolist() == lcp
        assert [tuple(t[i : i + cap]) for i in np.concatenate([x for x, _ in out])] == [tuple(t[i : i + cap]) for i in order]


def test_recursion_on_names_that_do_not_fit(tmp_path):
    t = np.array([1, 2, 2, 1, 1, 2, 3] * 400 + [1, 3] * 300 + [0], "u1")
    out = list(suffix_sort.suffix_order(t, 50, str(tmp_path), 300))
    assert np.concatenate([x for _, x in out]).tolist() == brute_order(t.tolist(), 50)[1]


def brute_repeats(texts, length):
    at = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, "i1")
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        out.append(gone[:-1].astype(bool))
    return out


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(2)
    mid = r.integers(97, 110, 700, dtype="u1")
    a, b = (np.concatenate([r.integers(97, 110, n, dtype="u1"), mid, r.integers(97, 110, 90, dtype="u1")]) for n in (311, 500))
    at = []
    for x, start in ((a, 311), (b, 500)):
        f, z, h = suffix_anchors.anchored_runs(x, 400)
        which = np.repeat(h, z - f + 1)
        assert len(which) == len(x) - 399
        at.append(which[start : start + 301])
    assert (at[0] == at[1]).all()


def test_removed_bytes_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(90), text(200)
    rows = [text(300) for _ in range(10)]
    rows += [text(r.randrange(0, 60)) + " " + passage[r.randrange(0, 30) :] + " " + text(40) for _ in range(40)]
    rows += [other] * 5 + [other[:700] + "!" + other[701:], "ab" * 600, "x" * 5000, "x" * 399, "x" * 400, None, "", passage + other + passage]
    near = text(400)
    for _ in range(12):
        k = r.randrange(len(near))
        rows.append(near[:k] + "#" + near[k + 1 :])
    df = spark.createDataFrame([(i % 30, t, "t1", 5) for i, t in enumerate(rows)], "doc_id long, text string, t1 string, w int").repartition(4)
    raw = [(t or "").encode() for t in rows]
    want = Counter()
    for t, gone in zip(raw, brute_repeats(raw, 400)):
        edge = np.diff(np.concatenate([[0], gone.view("i1"), [0]]))
        want[t, bytes(np.frombuffer(t, "u1")[~gone]), tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))] += 1
    got = Counter(((r.text or "").encode(), bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == want


def test_the_last_place_of_a_character_counts():
    r = random.Random(1)
    for _ in range(20):
        same = bytes(r.choice(b"abcdefgh ") for _ in range(403))
        assert [h.tolist() for h in suffix_sort.repeated([b"X" + same, b"Y" + same], [5, 5], 400)] == [[False, True, True, True, True]] * 2


def test_crowded_anchors_are_divided(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, ends = text(900), [text(700) for _ in range(6)]
    # the passage in 150 surroundings, some of them shared for a part of the way
    rows = [text(300) + r.choice(ends)[r.randrange(600) :] + passage[r.randrange(40) : 900 - r.randrange(40)] + r.choice(ends)[: r.randrange(120)] + text(300) for _ in range(150)]
    held = []
    step = suffix_dedup._sort_shards

    def measured(length, shard_bytes):
        run = step(length, shard_bytes)

        def sizes(batches):
            rows = pd.concat(list(batches), ignore_index=True)
            most = rows.groupby("a")["raw"].agg(lambda x: sum(map(len, x))).max() if len(rows) else 0
            assert most <= shard_bytes, f"{most} bytes under one anchor"
            yield from run([rows] if len(rows) else [])

        held.append(shard_bytes)
        return sizes

    monkeypatch.setattr(suffix_dedup, "_sort_shards", measured)
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(4)
    key = {(k.t1, k.t2): k.text.encode() for k in suffix_dedup._keyed(df, "text").collect()}
    got = {t: np.zeros(len(t), bool) for t in key.values()}
    for w in suffix_dedup.repeated_windows(df, shard_bytes=9000).collect():
        got[key[w.t1, w.t2]][w.s : w.e + 400] = True
    raw = [t.encode() for t in rows]
    assert held == [9000] and all((got[t] == gone).all() for t, gone in zip(raw, brute_repeats(raw, 400)))


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_queues_and_logs_of_a_production_shard_are_on_disk(monkeypatch):
    """A shard of the size that the query deals, sorted with its parameters, goes through files, and gives what memory alone gives."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    parts = [" ".join(r.choice(words) for _ in range(3000)).encode() for _ in range(70)]
    parts += [p[500:9000] for p in parts[:9]]
    starts = [len(p) - 399 for p in parts]
    assert sum(map(len, parts)) > 1 << 20
    seen, remove = {}, suffix_sort.shutil.rmtree
    monkeypatch.setattr(suffix_sort.shutil, "rmtree", lambda folder, **k: (seen.update({f.name: f.stat().st_size for f in Path(folder).rglob("*") if f.is_file()}), remove(folder, **k)))
    got = suffix_sort.repeated(parts, starts, 400)
    queues = {n: size for n, size in seen.items() if n.rsplit("-", 1)[0] in ("l", "s") and n.rsplit("-", 1)[1].isdigit()}
    assert len(queues) >= 4 and sum(queues.values()) > 1 << 22 and seen["l-done"] > 1 << 20
    want = suffix_sort.repeated(parts, starts, 400, 1 << 23)
    assert all((a == b).all() for a, b in zip(got, want)) and any(a.any() for a in got)
