import random

from pyspark.sql import functions as F

from talkweave.operators import search, search_index


def test_indexed_search_equals_scanning(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    words = ["alpha", "Beta", "straße", "STRASSE", "İstanbul", "ΣΑΣ", "naïve", "a.b*c", "\\E", "𝒳𝒴", "x", "ﬁne", "K2", "Kelvin"]
    rows = [(f"f{k % 7}", k, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(900)] + [("f9", 1, None), ("f9", 2, "")]
    df = spark.createDataFrame(rows, "file string, ord int, search_text string").repartition(5)
    monkeypatch.setattr(search_index, "BUCKET", 64)
    search_index.build_index(df, str(tmp_path / "index"))
    for q in ("alpha beta", "BETA", "straße", "rasse", "istanbul", "σας", "a.b*c", "\\e", "𝒳𝒴", "x", "K2 k2", "kelvin", " ", "nothing here", "fine", "ﬁne"):
        got = sorted(map(str, search_index.search_indexed(spark, str(tmp_path / "index"), q).select("file", "ord", "snippet").collect()))
        assert got == sorted(map(str, search.search(df, q).select("file", "ord", "snippet").collect())), q
    few = search_index.search_indexed(spark, str(tmp_path / "index"), "nothing here")
    assert few.count() == 0 and few.inputFiles() == []


def test_folding_joins_what_a_search_joins(spark):
    """Characters that match each other whatever their case are equal when folded."""
    every = spark.range(1, 0x1F000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    up = F.when(F.length(F.upper("c")) == 1, F.upper("c")).otherwise(F.col("c"))
    low = F.when(F.length(F.lower(up)) == 1, F.lower(up)).when(up == "İ", "i").otherwise(up)
    groups = every.select("c", low.alias("k"), search_index.folded(F.col("c")).alias("f")).groupBy("k").agg(F.countDistinct("f").alias("n"), F.collect_list("c").alias("cs")).where("n > 1")
    assert groups.collect() == []
