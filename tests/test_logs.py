"""Log files with every kind of line, through ingest, classification, branches and streams."""

import json

import pytest
from pyspark.sql import functions as F

from talkweave.operators import export, lineage, messages, search, sequence, summary
from talkweave.sources import logs
from talkweave.streaming import live


def line(uuid, type="user", content="hello there", parent=None, ts="2026-03-01T00:00:00Z", session="s1", **more):
    out = {"uuid": uuid, "parentUuid": parent, "sessionId": session, "type": type, "timestamp": ts}
    if content is not None:
        out["message"] = {"role": type, "content": content} | ({"usage": more.pop("usage")} if "usage" in more else {})
    return json.dumps(out | more)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    (top / "p1" / "subagents").mkdir(parents=True)
    image = {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "AAAA"}}
    (top / "p1" / "a.jsonl").write_text("\n".join([
        line("u1", content="[1]", cwd="/w", version="1"),
        "", "{broken", '"scalar"', "[1, 2]", '{"uuid": "x"} trailing',
        line("a1", "assistant", [{"type": "text", "text": "one"}, {"type": "text", "text": ""}, {"type": "text", "text": "two"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls\nx"}}], "u1", usage={"input_tokens": 5, "output_tokens": 2}),
        line("u2", content=[{"type": "tool_result", "tool_use_id": "t1", "content": "first"}], parent="a1"),
        line("u3", content=[{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "x"}, "y", {"type": "text", "text": ""}, image]}], parent="u2"),
        line("u4", content=[{"type": "tool_result", "tool_use_id": "t1", "content": ""}], parent="u3"),
        line("u5", content=[{"type": "text", "text": "look [Image: source: /i/a.png ]"}, image], parent="u4", cwd="/w/b"),
        line("a2", "assistant", [{"type": "tool_use", "id": "t2", "name": "Skill", "input": {}}, {"type": "tool_use", "id": "t3", "name": "Edit", "input": {"file_path": "/f", "old_string": "a\nb", "new_string": "c"}}], "u5"),
        json.dumps({"uuid": "b1", "type": "system", "subtype": "compact_boundary", "sessionId": "s1", "logicalParentUuid": "a2", "content": "compacted"}),
        json.dumps({"uuid": "d1", "uuid": "d2", "type": "progress", "sessionId": "s1"}),  # noqa: F601
        '{"uuid": "k1", "uuid": "k2", "type": "user", "sessionId": "s1", "message": {"content": "twice"}}',
    ]))
    (top / "p1" / "subagents" / "z.jsonl").write_text(line("z"))
    return str(top)


@pytest.fixture(scope="module")
def m(spark, root):
    return messages.enrich(logs.normalize_messages(logs.scan_logs(spark, root))).cache()


def test_scan_keeps_objects_in_order(m):
    rows = m.orderBy("ord").collect()
    assert [r.uuid for r in rows] == ["u1", "a1", "u2", "u3", "u4", "u5", "a2", "b1", "d2", "k2"]
    assert [r.ord for r in rows] == list(range(1, 11))


def test_text_and_content_kinds(m):
    got = {r.uuid: r for r in m.collect()}
    assert got["u1"].text == "[1]" and got["a1"].text == "one\ntwo" and got["b1"].text == "compacted" and got["u2"].text == ""
    assert [u for u in got if got[u].is_real_user] == ["u1", "u5", "k2"]
    assert got["a1"].usage.input == 5 and got["a1"].usage.cache_read == 0 and got["u1"].usage is None


def test_parts(m):
    parts = messages.explode_parts(m)
    calls = messages.tool_calls(parts)
    assert sorted(r.name for r in calls.collect()) == ["Bash", "Edit", "Skill"]
    results = messages.tool_results(parts)
    assert [r.result for r in results.orderBy("ord").collect()] == ["first", "x\ny"]
    paired = {r.id: r.result for r in messages.pair_tool_results(calls, results).collect()}
    assert paired == {"t1": "x\ny", "t2": None, "t3": None}
    assert messages.inline_images(parts).count() == 2 and messages.pasted_image_count(parts).first().n_images == 1
    assert [r.skill for r in messages.skill_invocations(calls).collect()] == ["unknown"]
    assert [(r.side, r.line) for r in messages.edit_lines(calls).orderBy("side", "line_no").collect()] == [("+", "c"), ("-", "a"), ("-", "b")]
    assert [r.line for r in export.tool_lines(calls).orderBy("ord", "pos").collect()] == ["[Bash] ls", "[Skill]", "[Edit] /f"]
    assert [r.path for r in messages.image_path_refs(m).collect()] == ["/i/a.png"]
    assert messages.token_usage(m).count() == 1
    found = search.search(search.searchable_text(m, parts), "LS\nX")
    assert [r.uuid for r in found.collect()] == ["a1"] and search.search(m, " ").count() == 0


def test_summary(m):
    s = summary.session_summary(m).first()
    assert (s.S, s.turn_count, s.message_count, s.compact_count, s.initial_cwd, s.first_user_message) == ("s1", 2, 9, 1, "/w", "[1]")
    assert summary.distinct_in_order(m, "cwd").first()["values"] == ["/w", "/w/b"]


def test_leaves_follow_logical_parents_only_upward(m):
    e = lineage.edges(m)
    assert {r.node for r in lineage.leaves(e).collect()} == {"a2", "b1", "d2", "k2"}
    way = lineage.ancestors(e, e.where("node = 'b1'").select("S", "node"))
    assert [r.node for r in way.orderBy("distance").collect()] == ["b1", "a2", "u5", "u4", "u3", "u2", "a1", "u1"]
    assert lineage.branch_messages(m, e.where("node = 'u2'").select("S", "node")).count() == 3


def forest(spark, rows):
    out = [("s", k, u, p, None, None, t, ts, x, t == "user") for k, (u, p, t, ts, x) in enumerate(rows)]
    return spark.createDataFrame(out, "S string, ord int, uuid string, parent string, logical_parent string, subtype string, type string, ts string, text string, is_real_user boolean")


def test_branches(spark):
    rows = [("r", None, "user", "00", "start"), ("x", "r", "assistant", "01", "ok")]
    for k in range(4):
        rows.append((f"m{k}", f"m{k - 1}" if k else "x", "user" if k % 2 == 0 else "assistant", f"1{2 * k}", f"main {k}"))
        if k < 3:
            rows.append((f"b{k}", f"b{k - 1}" if k else "x", "user" if k % 2 == 0 else "assistant", f"1{2 * k + 1}", f"side {k}"))
    rows.append(("late", "x", "user", "90", "late but alone"))
    m = forest(spark, rows)
    got = lineage.detect_branches(m).collect()
    assert [(r.branch_no, r.leaf, r.point, r.first_user_message, r.path_length, r.common) for r in got] == [(0, "b2", "x", "side 0", 5, 2)]
    b = lineage.detect_branches(m)
    assert lineage.branch_tree(b, lineage.plant(m)).first().parent_no is None
    s = summary.session_summary(m.withColumns({"is_sidechain": F.lit(False), **{c: F.lit(None).cast("string") for c in ("cwd", "version", "slug", "permission_mode")}}))
    assert {r.id for r in lineage.branch_rows(b, s).collect()} == {"s", "s:intra-0"}


def test_branch_rows_have_their_own_facts(spark):
    rows = [("r", None, "user", "00", "start"), ("x", "r", "assistant", "01", "ok")]
    for k in range(6):
        kind = "user" if k % 2 == 0 else "assistant"
        rows.append((f"m{k}", f"m{k - 1}" if k else "x", kind, f"1{k}a", f"main {k}"))
        if k < 5:
            rows.append((f"b{k}", f"b{k - 1}" if k else "x", kind, f"1{k}b", f"side {k}"))
        if 2 <= k < 5:
            rows.append((f"c{k}", f"c{k - 1}" if k > 2 else "b1", kind, f"1{k}c", f"inner {k}"))
    m = forest(spark, rows).withColumns({"is_sidechain": F.lit(False), **{c: F.lit(None).cast("string") for c in ("cwd", "version", "slug", "permission_mode")}})
    paths = lineage.plant(m)
    # as detected, a branch inside another has its point and first message where it leaves the main path
    b = spark.createDataFrame([("s", 0, "b4", "x", "side 0", 7, 2), ("s", 1, "c4", "x", "side 0", 7, 2)], "S string, branch_no int, leaf string, point string, first_user_message string, path_length long, common long")
    b = b.where("branch_no = 1 or leaf = 'b4'")
    got = {q.id: q for q in lineage.branch_rows(lineage.branch_facts(b, paths), summary.session_summary(m)).collect()}
    cols = ("created_at", "updated_at", "message_count", "turn_count", "first_user_message", "point", "leaf", "parent_id", "child_ids")
    facts = {k: tuple(q[c] for c in cols) for k, q in got.items()}
    assert facts["s"] == ("00", "15a", 16, 7, "start", None, None, None, facts["s"][-1])
    # both share more with each other than with main, so each is the other's parent, as the rule has it
    assert facts["s:intra-0"] == ("12b", "14b", 7, 3, "side 2", "b1", "b4", "s:intra-1", ["s:intra-1"])
    assert facts["s:intra-1"] == ("12c", "14c", 7, 3, "inner 2", "b1", "c4", "s:intra-0", ["s:intra-0"])
    one = {q.id: tuple(q[c] for c in cols) for q in lineage.branch_rows(lineage.branch_facts(b.where("branch_no = 0"), paths), summary.session_summary(m)).collect()}
    assert one["s:intra-0"] == ("10b", "14b", 7, 3, "side 0", "x", "b4", "s", []) and one["s"][-1] == ["s:intra-0"]


def test_cycles_end(spark):
    m = forest(spark, [("a", "c", "user", "1", "x"), ("b", "a", "user", "2", "x"), ("c", "b", "user", "3", "x"), ("t", "c", "user", "4", "x"), ("o", "gone", "user", "5", "x")])
    e = lineage.edges(m)
    got = {(r.start, r.node): r.distance for r in lineage.ancestors(e, lineage.leaves(e)).collect()}
    assert got == {("t", "t"): 0, ("t", "c"): 1, ("t", "b"): 2, ("t", "a"): 3, ("o", "o"): 0}


def test_clusters_allow_a_second(spark):
    rows = [("s", "a", "2026-01-01 00:00:00", "2026-01-01 00:10:00"), ("s", "b", "2026-01-01 00:09:59.5", "2026-01-01 00:20:00"), ("s", "c", "2026-01-01 00:15:00", "2026-01-01 00:16:00"), ("s", "d", None, None)]
    df = spark.createDataFrame(rows, "S string, file string, start string, end string").selectExpr("S", "file", "cast(start as timestamp) start", "cast(end as timestamp) end")
    assert {r.file: r.cluster for r in sequence.continuation_clusters(df).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    ids = lineage.cluster_ids(sequence.continuation_clusters(df))
    assert {r.id for r in ids.collect()} == {"s:branch-0", "s:branch-1", "s:branch-2"}


def test_a_session_of_many_files_is_clustered(spark):
    # long files that all overlap, then short ones that each fit a cluster: as many ends as files
    n = 20_000
    df = spark.range(2 * n).select(
        F.lit("s").alias("S"), F.col("id").alias("file"), F.timestamp_seconds(F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") + 10 * n)).alias("start"),
        F.timestamp_seconds(F.when(F.col("id") < n, F.col("id") + 2 * n).otherwise(F.col("id") + 20 * n)).alias("end"),
    ).repartition(4)
    got = sequence.continuation_clusters(df)
    assert got.where("cluster <> file % 20000").count() == 0 and got.count() == 2 * n


def turn_rows(spark, rows):
    return spark.createDataFrame([("s", 0, k, t, s, x, n) for k, (t, s, x, n) in enumerate(rows)], "S string, section_no int, ord int, type string, subtype string, text string, n_tools int")


def test_turns(spark):
    rows = [("assistant", None, "lead", 0), ("user", None, "q", 0), ("user", None, " ", 0), ("assistant", None, "", 0), ("assistant", None, "", 1), ("user", "command-output", "<command-name>/a</command-name>", 0),
            ("assistant", None, "x", 0), ("user", "command-output", "<local-command-stdout>b</local-command-stdout>", 0), ("user", "skill-output", "s", 0), ("user", None, "[Image: source: /a.png]", 0), ("user", None, "next", 0)]
    got = {r.ord: r.turn_no for r in sequence.turns(turn_rows(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 4: 1, 5: 2, 6: 2, 7: 2, 9: 2, 10: 3}


def test_shared_context(spark):
    rows = [("p", "p1", 1, "user"), ("p", "p2", 2, "assistant"), ("p", "px", 3, "progress"), ("p", "p3", 4, "user"), ("p", "p2", 5, "user"), ("q", "q1", 1, "user"), ("q", "q2", 2, "user")]
    m = spark.createDataFrame(rows, "S string, uuid string, ord int, type string")
    own = spark.createDataFrame([("a", "o1", 1, "user"), ("b", "o2", 1, "user"), ("c", "o3", 1, "user"), ("d", "o4", 1, "user")], "S string, uuid string, ord int, type string")
    links = spark.createDataFrame([("a", "p", "p2"), ("b", "q", "gone"), ("c", "p", "p1")], "S string, parent_S string, point string")
    trunk = spark.createDataFrame([("c", "t1", 1, "user")], "S string, uuid string, ord int, type string")

    def of(*more):
        got = {}
        for r in lineage.with_shared_context(own, m, links, *more).collect():
            got.setdefault(r.S, set()).add((r.uuid, r.is_shared))
        return got

    # up to the first row with the point's id; all of the parent's valid rows where it isn't
    assert of() == {"a": {("p1", True), ("p2", True), ("o1", False)}, "b": {("q1", True), ("q2", True), ("o2", False)}, "c": {("p1", True), ("o3", False)}, "d": {("o4", False)}}
    assert of(trunk)["c"] == {("t1", True), ("o3", False)}


def test_nested_branch_has_its_parent(spark):
    """The main chain, a branch beside it, and a branch that leaves this one after a stretch in which only the assistant speaks."""
    paths = {
        0: ["r", "x", "b0", "b1", "b2", "b3"],
        1: ["r", "x", "b0", "b1", "c0", "c1"],
        2: ["r", "x", "d0", "d1"],
    }
    branches = spark.createDataFrame([("s", k, p[-1], "x", "", len(p), 2) for k, p in paths.items()], "S string, branch_no int, leaf string, point string, first_user_message string, path_length long, common long")
    rows = {n: (n, p[i - 1] if i else None, "assistant", "1", "x") for p in paths.values() for i, n in enumerate(p)}
    got = lineage.branch_tree(branches, lineage.plant(forest(spark, list(rows.values())))).collect()
    assert {r.branch_no: r.parent_no for r in got} == {0: 1, 1: 0, 2: None}


def test_interleaved_nested_branches_are_detected(spark):
    rows = [("r", None, "user", "00", "start"), ("x", "r", "assistant", "01", "ok")]
    for k in range(8):
        kind = "user" if k % 2 == 0 else "assistant"
        rows.append((f"m{k}", f"m{k - 1}" if k else "x", kind, f"1{k}a", f"main {k}"))
        if k < 2:  # shared by both branches: the assistant alone
            rows.append((f"b{k}", f"b{k - 1}" if k else "x", "assistant", f"1{k}b", f"shared {k}"))
        elif k < 6:
            rows.append((f"c{k}", f"c{k - 1}" if k > 2 else "b1", kind, f"1{k}c", f"one {k}"))
            rows.append((f"d{k}", f"d{k - 1}" if k > 2 else "b1", kind, f"1{k}d", f"two {k}"))
    m = forest(spark, rows)
    b = lineage.detect_branches(m)
    got = lineage.branch_tree(b, lineage.plant(m)).orderBy("branch_no").collect()
    assert [(r.branch_no, r.leaf, r.point, r.first_user_message, r.path_length, r.common, r.parent_no) for r in got] == [
        (0, "c5", "x", "one 2", 8, 2, 1), (1, "d5", "x", "two 2", 8, 2, 0),
    ]


def test_depths(spark):
    m = forest(spark, [("a", None, "user", "1", "x"), ("b", "a", "user", "2", "x"), ("c", "b", "user", "3", "x"), ("o", "gone", "user", "4", "x"), ("p", "q", "user", "5", "x"), ("q", "p", "user", "6", "x"), ("t", "p", "user", "7", "x")])
    f = lineage.plant(m)
    depth = {r.node: r.depth for r in f.nodes.collect()}
    assert {n: depth[n] for n in "abco"} == {"a": 0, "b": 1, "c": 2, "o": 0} and depth["t"] == 2
    ends = lineage.leaves(lineage.edges(m)).select("S", F.col("node").alias("start"))
    assert {(r.start, r.message_count) for r in lineage.path_turn_counts(f, ends).collect()} == {("c", 3), ("t", 3), ("o", 1)}


def test_two_thousand_branches_on_one_trunk(spark):
    rows = [("t0", None, "user", "0000", "start")] + [(f"t{k}", f"t{k - 1}", "assistant", f"{k:04}", "on") for k in range(1, 300)]
    for k in range(2000):
        rows += [(f"b{k}", "t200", "user", f"{201 + k % 50:04}", f"question {k}"), (f"c{k}", f"b{k}", "user", f"{252 + k % 40:04}", "more")]
    m = forest(spark, rows)
    f = lineage.plant(m, forks_only=True)
    got = lineage.detect_branches(m, forest=f)
    assert got.count() == 2000 and got.where("point <> 't200' or common <> 201 or path_length <> 203").count() == 0
    assert f.nodes.count() == len(rows) and sum(r.count() for r in f.rounds) <= 9 * len(rows)  # nodes times the logarithm of the depth
    facts = lineage.branch_facts(got, f)
    assert facts.where("parent_no is null and created_at >= '0201' and message_count = 203").count() == 2000
    # under a shared stretch the lowest other number is the parent of all
    inside = got.withColumn("common", F.lit(100))
    tree = {r.branch_no: r.parent_no for r in lineage.branch_tree(inside, f).collect()}
    assert tree[0] == 1 and {p for n, p in tree.items() if n} == {0}


def test_only_assistants_tools_and_tokens_count(spark, tmp_path):
    (tmp_path / "p").mkdir()
    call = lambda name, path: {"type": "tool_use", "id": path, "name": name, "input": {"file_path": path}}
    (tmp_path / "p" / "a.jsonl").write_text("\n".join([
        line("u1", content=[{"type": "text", "text": "see [Image: source: /i/a.png] and [Image: source: b.png]"}, call("Write", "/user"), call("Skill", "/skill")], usage={"input_tokens": 7}),
        line("u2", content="[Image: source: /i/string.png]"),
        line("a1", "assistant", [{"type": "text", "text": "[Image: source: /i/assistant.png]"}, call("Read", "/i/a.png"), call("Edit", "/f")], usage={"input_tokens": 5}),
    ]))
    m = messages.enrich(logs.normalize_messages(logs.scan_logs(spark, str(tmp_path))))
    parts = messages.explode_parts(m)
    calls = messages.tool_calls(parts)
    assert {r.tool: r.n for r in summary.tool_usage(calls).collect()} == {"Read": 1, "Edit": 1} and messages.skill_invocations(calls).count() == 0
    assert summary.token_totals(messages.token_usage(m)).first().input == 5
    assert {r.path: r.actions for r in summary.session_file_actions(parts).collect()} == {"/i/a.png": ["read", "user-image"], "/f": ["edit"]}


def test_instruction_document(spark):
    rows = [("s", 1, "system", "claudeMd Contents of /w/CLAUDE.md (x):\nold\n"), ("s", 2, "system", "Contents of /w/CLAUDE.md (y):\n new\nlines \n\nContents of /z"), ("s", 3, "system", "CLAUDE.md only named"), ("s", 4, "user", "Contents of /w/CLAUDE.md:\nuser"), ("t", 1, "system", "Contents of CLAUDE.md:\nin a tag\n</tag>")]
    m = spark.createDataFrame(rows, "S string, ord int, type string, text string")
    assert {r.S: r.doc for r in messages.instruction_doc(m).collect()} == {"s": "new\nlines", "t": "in a tag"}


def test_transcripts_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("s", "# a", 1), ("s:intra-0", "# b", 2)], "id string, markdown string, n int")
    for _ in range(2):
        export.write_transcripts(docs, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("s", "# a"), ("s:intra-0", "# b")]


def test_file_tree(spark):
    paths = ["/a/b/c.py", "/a/b/d.py", "/x/y/z/only.txt", "/top.md", "/a/e.py", "/f", "/f/g"]
    refs = spark.createDataFrame([("s", p, p != "/a/e.py") for p in paths], "S string, path string, exists boolean")
    got = [(r.path, r["name"], r.parent, r.depth, r.is_file, r.n_files, r.n_deleted, r.place) for r in summary.file_tree(refs).collect()]
    assert sorted(got) == sorted([
        ("/a", "a", None, 0, False, 3, 1, 1), ("/f", "f", None, 0, True, 2, 0, 2), ("/top.md", "top.md", None, 0, True, 1, 0, 3), ("/x/y/z/only.txt", "x/y/z/only.txt", None, 0, True, 1, 0, 4),
        ("/a/b", "b", "/a", 1, False, 2, 0, 1), ("/a/e.py", "e.py", "/a", 1, True, 1, 1, 2), ("/a/b/c.py", "c.py", "/a/b", 2, True, 1, 0, 1), ("/a/b/d.py", "d.py", "/a/b", 2, True, 1, 0, 2),
        ("/f/g", "g", "/f", 1, True, 1, 0, 1),
    ])


def test_folder_closure_of_a_chain_and_a_cycle(spark):
    from talkweave.operators import annotate

    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("p", "q"), ("q", "p")]
    f = spark.createDataFrame(rows, "id string, parent_id string")
    got = {(r.ancestor, r.descendant): r.depth for r in annotate.folder_closure(f).collect()}
    assert got == {(x, y): j - i for i, x in enumerate("abcd") for j, y in enumerate("abcd") if i <= j} | {("p", "p"): 0, ("q", "q"): 0, ("p", "q"): 1, ("q", "p"): 1}


def test_annotations(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps({"folders": [{"id": "f", "name": "n", "parentId": None, "sessionIds": ["s1", "s2"]}], "sessionMeta": {"s1": {"customTitle": "t", "highlights": [{"id": "h", "text": "q"}]}}, "branchFolders": {"s1:intra-0": ["f", "g"]}, "branchMeta": {"s1:intra-0": {"notes": "n", "highlights": [{"id": "k"}]}}, "folderOrder": ["g", "f"]}))
    got = logs.load_annotations(spark, str(f))
    assert {k: v.count() for k, v in got.items()} == {"folders": 1, "folder_order": 2, "folder_members": 2, "branch_members": 2, "session_meta": 1, "highlights": 1, "branch_meta": 1, "branch_highlights": 1}
    assert all(v.count() == 0 for v in logs.load_annotations(spark, str(tmp_path / "none.json")).values())


def test_manifest(spark, root):
    now = logs.file_manifest(spark, root)
    assert now.count() == 1 and logs.manifest_diff(now, now).count() == 0
    assert [r.change for r in logs.manifest_diff(now.limit(0), now).collect()] == ["added"]


def test_backup(spark, tmp_path):
    raw = spark.createDataFrame([("s", 1, 1, "c"), ("s", 0, 2, "b"), ("s", 0, 1, "a")], "S string, file_no int, ord int, value string")
    export.write_backup(raw, str(tmp_path / "b"))
    assert [r.value for r in spark.read.text(str(tmp_path / "b" / "S=s")).collect()] == ["a", "b", "c"]
    export.write_backup(raw.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_full_transcript(spark):
    t = sequence.turns(turn_rows(spark, [("user", None, "# Head\nbody", 0), ("assistant", None, "answer", 0)])).withColumn("ts", F.lit("2026-03-01T10:05:00Z"))
    head = spark.createDataFrame([("s", "title", "2026-03-01T10:00:00Z", 1)], "S string, title string, created_at string, turn_count int")
    labels = spark.createDataFrame([("s", 0, "current", 1)], "S string, section_no int, kind string, n_users int")
    text = export.transcript_full(t, head, labels).first().markdown
    assert text == "# title\n\n> 3/1 10:00 | 1 turns\n\n##### # Head...\n\n*3/1 10:05*\n\n> **Head**\n> body\n\nanswer\n\n---\n"


def test_full_transcript_of_merged_turns_tools_and_sections(spark):
    rows = [("assistant", None, "lead", 0), ("user", "command-output", "<command-name>/a</command-name>", 0), ("assistant", None, "", 1), ("user", "command-output", "<local-command-stdout>b</local-command-stdout>", 0),
            ("user", None, "[Image: source: /a.png]", 0), ("user", None, "q", 0), ("assistant", None, "# H **x**\n```\n# code\n```\n## T", 0)]
    t = sequence.turns(turn_rows(spark, rows)).withColumn("ts", F.lit(None).cast("string"))
    head = spark.createDataFrame([("s", "t", "2026-03-01T10:00:00Z", 2, "Bash(1)")], "S string, title string, created_at string, turn_count int, tools string")
    labels = spark.createDataFrame([("s", 0, "original", 3), ("s", 1, "current", 1)], "S string, section_no int, kind string, n_users int")
    calls = spark.createDataFrame([("s", 2, 0, "> Read `/f`")], "S string, ord int, pos int, line string")
    text = export.transcript_full(t, head, labels, calls).first().markdown
    merged = "<command-name>/a</command-name>\n<local-command-stdout>b</local-command-stdout>\n[Image: source: /a.png]"
    assert text == "\n".join([
        "# t\n", "> 3/1 10:00 | 2 turns", "> Tools: Bash(1)", "", "## original\n", "lead\n", "---\n", "##### <command-name>/a</command-name>...\n", "\n".join("> " + x for x in merged.split("\n")), "",
        "> Read `/f`\n", "---\n", "##### q\n", "> q", "", "**H x**\n```\n# code\n```\n**T**\n", "---\n", "## current\n",
    ])


def test_headings_become_bold_outside_code(spark):
    said = ["# **Big** title\n####### no\n#no\n```\n# code\n```py\n# out", "```\n# code", "# a\n\n###### b ", "", "## \n# x\ry"]
    want = ["**Big title**\n####### no\n#no\n```\n# code\n```py\n**out**", "```\n# code", "**a**\n\n**b **", "", "## \n# x\ry"]
    docs = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    assert [r.text for r in sequence.demote_headings(docs).orderBy("id").collect()] == want
    fenced = sequence.doc_lines(docs).where("id = 0").orderBy("n").collect()
    assert [(r.n, r.in_code) for r in fenced] == list(enumerate([False, False, False, True, True, True, False]))


def test_activity(spark):
    rows = [("a", 0), ("a", 29), ("a", 60), ("b", 0)]
    df = spark.createDataFrame(rows, "S string, t int").select("S", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("time"))
    spells = live.active_sessions(df)
    assert sorted((r.S, r.n) for r in spells.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    at = lambda t: {r.S for r in live.active_at(spells, F.timestamp_seconds(F.lit(1_700_000_000 + t))).collect()}
    assert at(29) == {"a", "b"} and at(30) == {"a"} and at(59) == set() and at(60) == {"a"}
    assert live.new_sessions(df).count() == 2
