"""Rows kept over changes of log files equal those of a full run, and only touched files are read."""

import os

from talkweave.operators import library, messages
from talkweave.sources import logs
from talkweave.streaming import refresh

from .test_logs import line


def test_every_kind_of_change(spark, tmp_path):
    src, out = tmp_path / "logs", str(tmp_path / "out")
    (src / "p" / "subagents").mkdir(parents=True)
    (src / "q").mkdir()
    clock = [1_700_000_000]

    def put(name, lines):
        (src / name).write_text("\n".join(lines))
        clock[0] += 10
        os.utime(src / name, (clock[0], clock[0]))

    def check(*read):
        got_paths = {p.rsplit("/", 2)[1] + "/" + p.rsplit("/", 1)[1] for p in refresh.refresh(spark, str(src), out)}
        assert got_paths == set(read)
        m = messages.enrich(logs.normalize_messages(logs.scan_logs(spark, str(src))).where("S is not null"))
        want = sorted(str(tuple(r)) for r in library.library_rows(m.withColumn("file", refresh._uri("file"))).select(columns).collect())
        assert sorted(str(tuple(r)) for r in refresh.read_library(spark, out).select(columns).collect()) == want

    columns = ["id", "S", "cluster", "primary_file", "message_count", "turn_count", "created_at", "updated_at", "first_user_message", "parent_id", "child_ids", "point", "leaf"]
    put("p/a.jsonl", [line("a1", session="s1"), line("a2", "assistant", "yes", "a1", "2026-03-01T00:00:01Z", "s1")])
    put("p/b.jsonl", [line("b1", session="s2", ts="2026-03-02T00:00:00Z")])
    put("q/c.jsonl", [line("c1", session="s3", ts="2026-03-05T00:00:00Z")])
    put("q/none.jsonl", ['{"type": "summary"}', ""])
    check("p/a.jsonl", "p/b.jsonl", "q/c.jsonl", "q/none.jsonl")
    assert refresh.refresh(spark, str(src), out) == []  # nothing changed
    # a new file brings its session's other one; of a changed one, s2 goes and s4 comes; c stays unread
    put("q/d.jsonl", [line("d1", session="s1", ts="2026-03-07T00:00:00Z", content="goes on")])
    put("p/b.jsonl", [line("b2", session="s4", ts="2026-03-02T00:00:09Z")])
    check("q/d.jsonl", "p/a.jsonl", "p/b.jsonl")
    # s1 loses a file, s3 its only one, and a file without a session goes
    for name in ("q/d.jsonl", "q/c.jsonl", "q/none.jsonl"):
        (src / name).unlink()
    check("p/a.jsonl")
    (src / "p" / "b.jsonl").unlink()
    assert refresh.refresh(spark, str(src), out) == []
    assert sorted({r.S for r in refresh.read_library(spark, out).collect()}) == ["s1"]
