"""Long sessions are scanned in blocks, with the same rows as whole ones."""

import random

from pyspark.sql import functions as F

from talkweave.operators import sequence
from talkweave.operators.scan import blocked, scan


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def messages(spark, n=400):
    r, rows = random.Random(12), []
    for S, size in (("long", n), ("mid", 40), ("short", 3), ("none", 1)):
        for k in range(size):
            kind = r.choice(["user", "assistant", "user", "assistant", "system", "progress"])
            sub = r.choice([None, None, None, "command-output", "skill-output"])
            text = r.choice(["hello", " ", "x", "[Image: source: /a.png]", "<command-name>/c</command-name>"])
            rows.append((S, 10 * k, kind, sub, f"{text}{'' if text.startswith(('[', ' ')) else k}", r.random() < 0.06, r.random() < 0.1, k < 5 and S == "mid", r.randrange(3)))
    return spark.createDataFrame(rows, "S string, ord long, type string, subtype string, text string, is_boundary boolean, system_generated boolean, is_shared boolean, n_tools int").repartition(3)


def test_sections_and_turns(spark):
    m = messages(spark)
    whole = sequence.sections(m)
    same(sequence.sections(m, block=30), whole)
    assert whole.where("S = 'long'").select("section_no").distinct().count() > 5
    one = m.withColumn("section_no", F.lit(0))
    for block in (7, 60):
        same(sequence.turns(one, block=block), sequence.turns(one))


def test_segments(spark):
    r = random.Random(4)
    items = [("s", 0, t, k // 2, k % 2, r.choice(["text", "tool", "tool", "tool"])) for t, n in ((0, 200), (1, 5)) for k in range(n)]
    df = spark.createDataFrame(items, "S string, section_no int, turn_no int, ord int, pos int, kind string")
    same(sequence.segments(df, block=9), sequence.segments(df))


def test_scan_carries_over_empty_blocks(spark):
    df = spark.createDataFrame([("s", k, k if k in (2, 3, 45) else None) for k in (1, 2, 3, 9, 30, 31, 45, 46, 90)], "S string, ord int, v int")
    got = scan(blocked(df, size=10), ("S",), ("ord",), sums={"n": F.lit(1)}, lasts={"v0": F.col("v")}).orderBy("ord").collect()
    assert [q.n for q in got] == list(range(1, 10)) and [q.v0 for q in got] == [None, None, 2, 3, 3, 3, 3, 45, 45]


def test_clusters_of_pieces(spark):
    """Long sessions, folded in pieces, against the plain rule: the first cluster whose end isn't more than a second after the start."""
    r, rows = random.Random(8), []
    for S in range(30):
        at = 0
        for k in range(r.randrange(1, 60)):
            at += r.choice([0, 1, 2, 5, 30])
            start = None if r.random() < 0.05 else at
            end = None if r.random() < 0.15 else at + r.choice([0, 1, 3, 10, 25])
            rows.append((S, f"f{k:02}", start, end))
    t = lambda c: F.timestamp_seconds(F.col(c) + 1_700_000_000).alias(c)
    df = spark.createDataFrame(rows, "S int, file string, start long, end long").select("S", "file", t("start"), t("end")).repartition(3)
    got = {(q.S, q.file): q.cluster for q in sequence.continuation_clusters(df, most=2).collect()}
    assert len(got) == len(rows)
    for S in range(30):
        ends = []
        for _, file, start, end in sorted((x for x in rows if x[0] == S), key=lambda x: (x[2] is None, x[2] or 0, x[3] is not None, x[3] or 0, x[1])):
            fits = [i for i, e in enumerate(ends) if start is not None and e is not None and start >= e - 1]
            if fits:
                k = fits[0]
                ends[k] = max(ends[k], end if end is not None else ends[k])
            else:
                k = len(ends)
                ends.append(None if start is None else end)
            assert got[S, file] == k, (S, file)
    same(sequence.continuation_clusters(df, most=2), sequence.continuation_clusters(df))
