from talkweave.operators import sequence


def test_heading_lines_and_outline_differ(spark):
    """A tab after the hashes makes an outline entry and no heading line; hashes and a space alone make a heading line and no entry."""
    texts = {1: "# a\n#\tb\n# c\nplain\n# a", 2: "# \n# x\n```\n# code\n```\n# y", 3: "", 4: "#\tq\n#\tr\n# s"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {(r.id, r.n): (r.line, r.is_heading, r.slug) for r in sequence.source_lines(docs).collect()}
    toc = sorted((r.id, r.n, r.slug) for r in sequence.heading_toc(docs).collect())
    want = {}
    for k, t in texts.items():
        slugs = iter([s for d, _, s in toc if d == k])
        code = False
        for n, line in enumerate(t.split("\n")):
            fence = line.startswith("```")
            code ^= fence
            heading = not (code or fence) and line.startswith("# ")
            want[k, n] = (line, heading, next(slugs, None) if heading else None)
    assert got == want


def test_lines_are_read_and_dealt_once(spark):
    docs = spark.createDataFrame([(1, "# a\nb")], "id long, text string").repartition(2)
    plan = sequence.source_lines(docs)._jdf.queryExecution().sparkPlan().toString() + sequence.source_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("posexplode") <= 2
