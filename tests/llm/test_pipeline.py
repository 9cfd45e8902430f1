"""The pipeline on a small fixture: each stage's decisions against brute force, from that stage's own input."""

import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkweave.llm import quality
from talkweave.llm.simhash import simhash

from .test_lines import brute as brute_lines
from .test_simhash import closure

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_docs():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randrange(2, 9)))
    known = [word() for _ in range(400)]
    line = lambda n: " ".join(r.choice(known) for _ in range(n)).capitalize() + "."
    passage = " ".join(r.choice(known) for _ in range(90))
    rows, good = [], {}
    for i in range(120):
        if i % 4 == 3:
            text, good[i] = "\n".join("".join(r.choice("#$%&@!~^*0123456789 ") for _ in range(60)) for _ in range(5)), 0
        else:
            text, good[i] = "\n".join(line(r.randrange(8, 25)) for _ in range(5)), 1
            if i % 12 == 0:
                text += "\n" + line(10)[:-1] + " " + passage + " " + line(12).lower()
        rows.append((i, text))
    rows += [(200, rows[0][1]), (201, rows[1][1] + " x"), (202, None), (203, "")]
    return rows, good


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(input rows, output rows)] of all stages, and the labels."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows, good = make_docs()
    typed = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(typed, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{sf_dir}/stage{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return sf_dir, out, good


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(set(after.columns) == set(COLUMNS) for _, after in stages[1][:-1])
    for _, after in stages[1][1:-1]:
        assert after.where(~F.col("n_chars").eqNullSafe(F.length("text"))).where("text is not null").count() == 0


def test_quality_keeps_what_scores_well(spark, stages):
    sf_dir, ((before, after), *_), good = stages
    model = quality.train(before.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score(before, model).select("doc_id", "score").collect()}
    want, got = texts(before), texts(after)
    assert got == {i: want[i] for i, s in score.items() if s >= 0.5}
    judged = [i for i in good if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in got) == good[i] for i in judged) >= 0.9 * len(judged)


def test_lines_equal_brute_force(stages):
    before, after = stages[1][1]
    assert texts(after) == dict(brute_lines(sorted(texts(before).items())))


def test_one_of_each_near_duplicate_group(stages):
    before, after = stages[1][2]
    want = texts(before)
    fp = {i: simhash(t) & (1 << 64) - 1 for i, t in want.items()}
    ids = sorted(fp)
    root = closure(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3])
    least = {}
    for i in ids:
        least[root[i]] = min(i, least.get(root[i], i))
    assert texts(after) == {i: want[i] for i in least.values()}


def test_repeated_strings_go(stages):
    before, after = stages[1][3]
    want, seen = texts(before), {}
    raw = {i: (t or "").encode() for i, t in want.items()}
    for i, b in raw.items():
        for s in range(len(b) - 399):
            seen.setdefault(b[s : s + 400], []).append((i, s))
    cover = {i: bytearray(len(b)) for i, b in raw.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + 400] = b"\1" * 400
    assert any(map(any, cover.values()))
    left = {i: bytes(x for x, c in zip(raw[i], cover[i]) if not c).decode() for i in raw}
    assert texts(after) == {i: None if want[i] is None else left[i] for i in want}


def test_all_that_is_left_is_packed(stages):
    import public_tokenizers

    before, after = stages[1][4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in texts(before).items()}
    rows = after.select("doc_id", "length", "sequence_id", "offset").collect()
    total, held = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == want
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_run_equals_its_stages(spark, stages):
    sf_dir, out, _ = stages
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert got == sorted(map(tuple, out[-1][1].select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_no_documents_give_no_rows(spark, stages, tmp_path):
    sf_dir, _, _ = stages
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_and_clashing_columns_lose_nothing(spark, stages):
    """Rows that share an id, or have none, are documents of their own in each stage; other columns pass through."""
    sf_dir, _, _ = stages
    line = "a line of plain words number {} that nothing else repeats in any way at all."
    rows = [(i // 2, line.format(chr(97 + i) * 40), "en", "web", 1, f"x{i}") for i in range(6)] + [(None, line.format("z" * 40), "en", "web", 1, "x6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        assert sorted((r.text, r._gone) for r in after.collect()) == sorted((r[1], r[5]) for r in rows)
