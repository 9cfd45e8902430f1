"""The live library: a store of many small batches, its versions and merges, and what a stream of log files leaves in it."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from talkweave.operators import library, messages
from talkweave.sources import logs
from talkweave.streaming import live
from talkweave.streaming.store import Store

from .test_logs import line, root  # noqa: F401


def frame(spark, rows):
    return spark.createDataFrame(rows, "S string, n int")


def test_store_merges_and_keeps_versions(spark, tmp_path):
    log, table = Store(spark, str(tmp_path / "log"), order=("n",), fanout=3), Store(spark, str(tmp_path / "table"), replaces=True, fanout=3)
    r, every, newest = random.Random(3), [], {}
    for k in range(8):
        rows = [(f"s{r.randrange(9)}", 100 * k + i) for i in range(r.randrange(1, 7))]
        for s in (log, table):
            s.append(frame(spark, rows), k)
            s.append(frame(spark, [("s1", -1)]), k)  # a batch that comes again
        every += rows
        newest |= {S: sorted(n for s, n in rows if s == S) for S, _ in rows}
    assert sorted((q.S, q.n) for q in log.read().collect()) == sorted(every)
    assert sorted((q.S, q.n) for q in table.read().collect()) == sorted((S, n) for S, ns in newest.items() for n in ns)
    some = frame(spark, [("s2", 0), ("s5", 0), ("none", 0)])
    assert sorted((q.S, q.n) for q in log.read(some).collect()) == sorted(x for x in every if x[0] in ("s2", "s5"))
    assert sorted((q.S, q.n) for q in table.read(some).collect()) == sorted((S, n) for S in ("s2", "s5") for n in newest.get(S, []))
    now = log.snapshot()
    per_level = [sum(x["level"] == k for x in now.runs) for k in range(4)]
    assert max(per_level) < 3 and len(now.runs) <= 6 and len(list((tmp_path / "log" / "manifest").glob("*.json"))) == 3
    held = {f.name for f in (tmp_path / "log" / "runs").iterdir()}
    assert {x["name"] for x in now.runs} <= held and len(held) <= len(now.runs) + 8


def test_reader_sees_one_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), replaces=True, fanout=2)
    s.append(frame(spark, [("a", 1), ("b", 1)]), 0)
    before = s.snapshot()
    s.append(frame(spark, [("a", 2)]), 1)
    assert sorted(map(tuple, s.read(now=before).select("S", "n").collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, s.read().select("S", "n").collect())) == [("a", 2), ("b", 1)]
    s.append(frame(spark, []), 2)
    assert s.snapshot().batch == 2 and s.read().count() == 2
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "none")).read()


def test_files_read_follow_the_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), fanout=2)
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id") % 5000).alias("S"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        s.append(rows, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    every = [f for r in s.snapshot().runs for f in r["files"]]
    one = s.files(spark.createDataFrame([("k7",)], "S string"))
    assert len(every) >= 4 and len(one) == 1 and sum(f[3] for f in one) < sum(f[3] for f in every) / 2
    keys = spark.createDataFrame([("k7",)], "S string")
    assert s.read(keys).count() == 40 and len(s.read(keys).inputFiles()) == 1


def current(spark, out, source):
    m = messages.enrich(logs.normalize_messages(logs.scan_logs(spark, str(source)))).where("S is not null")
    want = library.library_rows(m)
    got = live.read_current(spark, str(out / "live")).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    return {r.id: r for r in got.collect()}


def branch_lines(session, at):
    """A trunk of two, then two paths that alternate in time."""
    out = [line(f"{session}r", ts=f"{at}:00Z", session=session), line(f"{session}x", "assistant", "ok", f"{session}r", f"{at}:01Z", session)]
    for k in range(8):
        side, n = "mb"[k % 2], k // 2
        parent = f"{session}{side}{n - 1}" if n else f"{session}x"
        if side == "b" and n == 3:
            continue
        out.append(line(f"{session}{side}{n}", "user" if n % 2 == 0 else "assistant", f"{side} says {n}", parent, f"{at}:{10 + k}Z", session))
    return out


def test_live_rows_equal_batch(spark, root, tmp_path):  # noqa: F811
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "p2").mkdir(parents=True)
    shutil.copytree(f"{root}/p1", src / "p1", ignore=shutil.ignore_patterns("subagents"))
    exports = live.stream_exports(str(out / "md"), str(out / "backup"), fanout=2)
    start = lambda: live.live_summary(live.stream_logs(spark, str(src)), str(out / "live"), str(out / "cp"), after=exports, fanout=2)
    q = start()
    q.processAllAvailable()

    def land(name, lines):
        (tmp_path / name).write_text("\n".join(lines))
        (tmp_path / name).rename(src / "p2" / name)

    land("b.jsonl", [line(f"v{k}", ts=f"2026-03-02T00:00:0{k}Z", session=f"s{1 + k % 2}", content=f"text {k}", version=str(k)) for k in range(6)])
    q.processAllAvailable()
    q.stop()
    q = start()  # goes on where it stopped
    land("c.jsonl", branch_lines("s3", "2026-03-05T00:00"))
    land("d.jsonl", [line("o1", ts="2026-03-05T00:00:05Z", session="s3", parent="s3x", content="beside"), line("o2", "assistant", "yes", "o1", "2026-03-05T00:00:06Z", "s3")])
    land("e.jsonl", [line("z", ts="2026-03-09T00:00:00Z", session="s2", content="later")])
    q.processAllAvailable()
    q.stop()
    last = current(spark, out, src)
    assert last["s2"].message_count == 4 and last["s1"].version == "4" and last["s1"].first_user_message == "[1]"
    # overlapping files are clusters with rows of their own, and the branch is inside one of them
    assert {i for i, r in last.items() if r.S == "s3"} == {"s3:branch-0", "s3:branch-1", "s3:branch-0:intra-0"}
    assert last["s3:branch-1"].parent_id == "s3:branch-0" and last["s3:branch-1"].point == "s3x"
    assert last["s3:branch-0:intra-0"].parent_id == "s3:branch-0" and last["s3:branch-0"].child_ids == ["s3:branch-0:intra-0"]
    notes = {r.S: r.markdown for r in live.read_exports(spark, str(out / "md")).collect()}
    assert set(notes) == {"s1", "s2", "s3"} and "[Bash] ls" in notes["s1"] and "> 3/1 00:00 | 2 turns | Tools: " in notes["s1"] and "later" in notes["s2"]
    backup = {p.name[2:]: "".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in (out / "backup").iterdir() if p.is_dir()}
    assert set(backup) == {"s1", "s2", "s3"} and backup["s3"].count("\n") == 11 and '"later"' in backup["s2"] and backup["s2"].count("\n") == 4
