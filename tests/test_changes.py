"""Change logs, names and texts against plain loops."""

import random
import time

from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import annotate, search


def test_moves_equal_one_after_another(spark):
    r = random.Random(6)
    for n, many in ((2, 6), (12, 40), (60, 120)):
        parent = {f"f{k}": (f"f{r.randrange(k)}" if k and r.random() < 0.8 else None) for k in range(n)}
        folders = spark.createDataFrame(list(parent.items()), "id string, parent_id string")
        moves = [(f"f{r.randrange(n)}", r.choice([None, "gone", *(f"f{r.randrange(n)}" for _ in range(8))]), k) for k in range(many)] + [("nobody", "f0", 999)]
        if n == 2:
            moves = [("f0", "f1", 1), ("f1", "f0", 2), ("f1", None, 3), ("f0", "f1", 4)]
            folders, parent = spark.createDataFrame([("f0", None), ("f1", None)], folders.schema), {"f0": None, "f1": None}
        got = {q.id: q.parent_id for q in annotate.apply_folder_moves(folders, spark.createDataFrame(moves, "id string, parent_id string, seq int")).collect()}
        for x, p, _ in moves:
            at = p
            while at is not None and at != x:
                at = parent.get(at)
            if x in parent and at is None and (p is None or p in parent):
                parent[x] = p
        assert got == parent and len(got) == n
    f = spark.createDataFrame([("a", None), ("b", None)], "id string, parent_id string")
    both = annotate.apply_folder_moves(f, spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], "id string, parent_id string, seq int"))
    assert {q.id: q.parent_id for q in both.collect()} == {"a": "b", "b": None} and annotate.load_folder_tree(both).count() == 2
    assert annotate.apply_folder_moves(f, spark.createDataFrame([], "id string, parent_id string")).count() == 2


def test_names_equal_a_plain_loop(spark):
    r = random.Random(2)
    stock = ["a", "a", "a (2)", "a (3)", "a (2) (2)", "b", "b/", "", " b  (2)", "c (2)", "d"]
    rows = [(k, r.choice(["p", "q", None, ""]), r.choice(stock)) for k in range(400)] + [(400 + k, "r", x) for k, x in enumerate(("a", "a", "a (2)"))]
    got = {q.id: q.safe_name for q in annotate.unique_names(spark.createDataFrame(rows, "id int, parent string, name string").repartition(3)).collect()}
    taken = set()
    for k, parent, name in rows:
        base = " ".join("".join(c for c in name if c != "/").split()) or "untitled"
        free, n = base, 2
        while (parent, free) in taken:
            free, n = f"{base} ({n})", n + 1
        taken.add((parent, free))
        assert got[k] == free
    assert len(got) == len(rows) and [got[400], got[401], got[402]] == ["a", "a (2)", "a (2) (2)"]


def test_a_megabyte_of_fences_takes_seconds(spark):
    text = "# a\n```\n# b\n```\n" * 64_000
    df = spark.createDataFrame([(1, text)], "id int, text string")
    began = time.time()
    got = df.select(F.explode(T.lines("text")).alias("x")).groupBy("x.line", "x.in_code").count().collect()
    assert {(q.line, q.in_code): q["count"] for q in got} == {("# a", False): 64_000, ("```", True): 128_000, ("# b", True): 64_000, ("", False): 1}
    assert time.time() - began < 30


def test_matches_of_any_case_and_length(spark):
    rows = [(1, "İ" * 70 + "Find ME" + "x" * 80), (2, "\U0001f600" * 65 + "fInD me"), (3, "find\nme"), (4, None), (5, "FIND MEfind me"), (6, "ΣΑΣ")]
    m = spark.createDataFrame(rows, "id int, search_text string")
    got = {q.id: q.snippet for q in search.search(m, "find me").collect()}
    assert set(got) == {1, 2, 5} and got[1] == "..." + "İ" * 60 + "Find ME" + "x" * 60 + "..." and got[2] == "..." + "\U0001f600" * 60 + "fInD me"
    assert [q.id for q in search.search(m, "σας").collect()] == [6] and search.search(m, ".*").count() == 0 == search.search(m, "\\E.*\\Q").count()
    n = lambda t, q: spark.createDataFrame([(t,)], "t string").select(search.occurrences(F.col("t"), q)).first()[0]
    assert n("aAaa", "aa") == 3 and n("İxİ", "İ") == 2 and n("a\\Eb", "\\e") == 1 and n("", "a") == 0
    began = time.time()
    assert n("ab" * 200_000, "aba") == 199_999 and time.time() - began < 10
