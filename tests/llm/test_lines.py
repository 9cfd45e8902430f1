import random

from pyspark.sql import functions as F

from talkweave.llm import line_dedup

from .test_simhash import closure


def grams(line, n=10):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute(rows):
    """Texts left of (id, text) rows."""
    at = [(i, p, x.lower().strip(" ")) for i, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    at = [x for x in at if x[2]]
    kinds = sorted({x for _, _, x in at})
    sets = {x: grams(x) for x in kinds}
    links = [(a, b) for k, a in enumerate(kinds) for b in kinds[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = closure(kinds, links)
    least = {}
    for i, p, x in at:
        key = (i is not None, i, p)
        least[root[x]] = min(least.get(root[x], key), key)
    gone = {(i, p) for i, p, x in at if least[root[x]] != (i is not None, i, p)}
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows]


def make_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(1, 10)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(40) for _ in range(30)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(6):
            x = r.choice(base).split(" ") if r.random() < 0.7 else line(r.randrange(1, 30)).split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                x[r.randrange(len(x))] = word()
            out.append(" ".join(x))
        rows.append((i, "\n".join([*out, "", "Short", " short "])))
    hot = line(60).split(" ")
    for i in range(60, 160):
        x = list(hot)
        x[i % 60] = word()
        rows.append((i, " ".join(x)))
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300))
    rows += [(200, cjk), (201, cjk[:150] + "x" + cjk[150:]), (202, "y " * 3000), (203, "y " * 2990), (204, "z" * 2500), (205, "z" * 2400 + "q")]
    return [*rows, (None, "short\nonly here"), (300, None), (301, ""), (302, "\n\n")]


def test_equals_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit("p"), "k": F.lit(1), "id": F.lit("i")}).repartition(3)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = dict(brute(rows))
    assert got.keys() == want.keys()
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, [(i, got[i], want[i]) for i in wrong[:2]]


def test_no_rows_and_repeats(spark, no_docs):
    assert line_dedup.drop_repeated_lines(no_docs).collect() == []
    same = spark.createDataFrame([(1, "one line\nOne Line"), (1, "one line\nOne Line")], "doc_id long, text string")
    assert [r.text for r in line_dedup.drop_repeated_lines(same).collect()] == ["one line", "one line"]


def test_rows_that_share_an_id_lose_no_unlike_text(spark):
    rows = [(0, "first text of all"), (1, "first text of all"), (1, "another text under that id"), (None, "a third text, without an id"), (None, "and one more of these")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _gone int, parts int, r1 int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted(r.text for r in got.collect()) == sorted(["first text of all", "", *(t for _, t in rows[2:])])


def test_signature_stays_on_the_jvm(spark):
    df = spark.createDataFrame([(1, "a line of text to sign\nshort")], "doc_id long, text string")
    signed = line_dedup.signatures(line_dedup.lines(df, "doc_id", "text"), 10, 12, 10)
    plan = signed._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_recall_at_the_threshold(spark):
    """Of pairs of lines near Jaccard 0.8, short and long, nearly all share a bucket."""
    r = random.Random(9)
    pairs = []
    for n in [*range(14, 60, 2)] * 12 + [*range(80, 600, 20)] * 8:
        x = "".join(r.choice("abcdefghij klmnop") for _ in range(n))
        for _ in range(40):
            y = list(x)
            for _ in range(max(1, n // 110)):
                y[r.choice([0, 1, -1, r.randrange(n)])] = "Z"
            y = "".join(y) + "q" * r.randrange(2)
            j = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
            if 0.8 <= j < 0.9:
                pairs.append((x, y))
                break
    assert len(pairs) > 300
    rows = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "k1 long, line string").withColumn("k2", F.lit(0).cast("long"))
    got = {row.k1: {row[f"b{i}"] for i in range(10)} for row in line_dedup.signatures(rows, 10, 12, 10).collect()}
    met = [bool(got[2 * i] & got[2 * i + 1]) for i in range(len(pairs))]
    assert sum(met) >= 0.97 * len(met)
    short = [m for m, (x, _) in zip(met, pairs) if len(x) < 40]
    assert sum(short) >= 0.95 * len(short)


def test_blocks_of_a_bucket_meet(spark):
    """A bucket dealt into many blocks gives the links that all its pairs give."""
    r = random.Random(2)
    base = "".join(r.choice("abcdefghijkl") for _ in range(120))
    texts = sorted({base[: 60 + i] + "".join(r.choice("xyz") for _ in range(i % 7)) for i in range(50)})
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k1 long, k2 long, line string")
    own = line_dedup.shingle_sets(lines, 10)
    assert {r.k.k1: len(r.s) for r in own.collect()} == {i: len(grams(t)) for i, t in enumerate(texts)}
    df = own.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), "k", F.col("k").alias("component"))
    got = {(x.src.k1, x.dst.k1) for x in line_dedup.links_across(df, line_dedup.apart_lines(df, own), 0.8, block_lines=7).collect()}
    sets = [grams(t) for t in texts]
    assert got == {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_a_group_of_near_copies_leaves_few_pairs_apart(spark):
    """Many near copies in a bucket, most pairs of them similar: draws leave no more pairs to join than rows, and lose no link."""
    r = random.Random(6)
    base = [r.choice("abcdefghijkl") for _ in range(400)]
    texts = []
    for i in range(160):
        x = list(base)
        for _ in range(r.randrange(1, 9)):
            x[r.randrange(400)] = "Z"
        texts.append("".join(x))
    texts += ["".join(r.choice("mnop") for _ in range(80)) for _ in range(20)]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k1 long, k2 long, line string")
    own = line_dedup.shingle_sets(lines, 10)
    df = own.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), "k", F.col("k").alias("component"))
    rest = line_dedup.saved(df, "mixed")
    mine = line_dedup.apart_lines(rest, own)
    rest, drawn = line_dedup.draw_together(rest, mine, 0.8, least=20, block_lines=50)
    sets = [grams(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 2 * len(texts) * 2
    label = {x.k.k1: x.component.k1 for x in rest.collect()}
    assert len(label) == len(texts)
    assert sum(label[a] != label[b] for a, b in pairs) <= rest.count()
    found = [(x.src.k1, x.dst.k1) for t in [*drawn, line_dedup.links_across(rest, mine, 0.8, block_lines=50)] for x in t.collect()]
    assert closure(range(len(texts)), found) == closure(range(len(texts)), pairs)


def test_a_draw_relabels_lines_not_rows_of_buckets(spark, monkeypatch):
    """A group of near copies in ten buckets takes several draws: each gives its lines new components, and the rows of all buckets get theirs once."""
    r = random.Random(8)
    base = [r.choice("abcdefghijkl") for _ in range(400)]
    texts = []
    for i in range(120):
        x = list(base)
        for _ in range(r.randrange(1, 6)):
            x[r.randrange(400)] = "Z"
        texts.append("".join(x))
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k1 long, k2 long, line string")
    own = line_dedup.shingle_sets(lines, 10)
    df = own.select(F.explode(F.sequence(F.lit(1), F.lit(10))).alias("band"), "k", F.col("k").alias("component"))
    rest = line_dedup.saved(df, "mixed")
    mine = line_dedup.apart_lines(rest, own)
    wrote, save = [], line_dedup.saved

    def seen(table, name):
        out = save(table, name)
        if {"k", "component"} <= set(out.columns):
            wrote.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "saved", seen)
    rest, drawn = line_dedup.draw_together(rest, mine, 0.8, least=20)
    assert drawn
    large, *labels, once, _ = wrote
    assert (large, once) == (1200, 1200)
    assert labels == [120] * (1 + len(drawn))
