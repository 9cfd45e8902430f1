"""Registered queries: each operator on the shared tables, with the SQL its result is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import annotate, export, lineage, messages, search, search_index, sequence, summary
from talkweave.operators.durable import shared_folder
from talkweave.plans import tables as P
from talkweave.sources import logs
from talkweave.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "", recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{ctes} {sql}" if ctes else sql
        return f

    return add


_SYS = "(regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' OR starts_with(ltrim(text, ' '), '<task-notification>') OR starts_with(text, 'This session is being continued') OR text IN ('Tool loaded.', 'Continue from where you left off.', 'No response requested.') OR regexp_matches(text, '^\\[Image: source: [^\\]]+\\](\\s*\\[Image: source: [^\\]]+\\])*\\s*$'))"
_CLASSED = P.MESSAGES + f""", m AS (SELECT *, type = 'user' AND NOT {_SYS} AS is_real_user FROM msg)"""
_SECTIONED = _CLASSED + """, cut AS (SELECT *, sum(CAST(is_boundary AS INT)) OVER (PARTITION BY "S" ORDER BY ord) AS part FROM m),
 sec AS (SELECT *, dense_rank() OVER (PARTITION BY "S" ORDER BY part) - 1 AS section_no FROM cut WHERE type IN ('user', 'assistant') AND NOT (type = 'user' AND NOT is_real_user) AND NOT is_boundary),
 lab AS (SELECT s."S", section_no, count(*) FILTER (type = 'user') AS n_users, CASE WHEN part = b.n THEN 'current' WHEN part = 0 THEN 'original' ELSE 'after-compaction ' || part END AS kind
  FROM sec s JOIN (SELECT "S", sum(CAST(is_boundary AS INT)) AS n FROM m GROUP BY 1) b ON s."S" = b."S" GROUP BY s."S", section_no, part, b.n),
 turned AS (SELECT *, sum(CAST(type = 'user' AS INT)) OVER (PARTITION BY "S", section_no ORDER BY ord) AS turn_no FROM sec WHERE text <> '')"""
_SUMMARY = _CLASSED + """, summary AS (SELECT "S", coalesce(min(ts) FILTER (NOT is_sidechain), min(ts)) AS created_at, coalesce(max(ts) FILTER (NOT is_sidechain), max(ts)) AS updated_at,
 count(*) FILTER (type IN ('user', 'assistant', 'system')) AS message_count, least(count(*) FILTER (is_real_user), count(*) FILTER (type = 'assistant')) AS turn_count,
 count(*) FILTER (type = 'system' AND subtype = 'compact_boundary') AS compact_count, arg_min(cwd, ord) FILTER (NOT is_sidechain) AS initial_cwd, arg_max(permission_mode, ord) AS permission_mode,
 arg_max(version, ord) AS version, arg_min(slug, ord) FILTER (slug IS NOT NULL) AS slug,
 left(coalesce(arg_min(text, ord) FILTER (type = 'user' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''), arg_min(text, ord) FILTER (type = 'user'), ''), 200) AS first_user_message FROM m GROUP BY "S")"""


def _messages(spark, sf_dir):
    return messages.classify(P.messages(spark, sf_dir).withColumn("stored", F.col("subtype"))).withColumn("subtype", F.col("stored")).drop("stored")


def _sectioned(spark, sf_dir):
    return sequence.sections(_messages(spark, sf_dir))


def _summary(spark, sf_dir):
    return summary.session_summary(_messages(spark, sf_dir))


@query('SELECT * FROM summary', _SUMMARY)
def e1_session_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query('SELECT "S", updated_at, turn_count, message_count, first_user_message FROM summary', _SUMMARY)
def h1_sessions_by_recency(spark, sf_dir):
    return _summary(spark, sf_dir).orderBy(F.desc("updated_at"), "S").select("S", "updated_at", "turn_count", "message_count", "first_user_message")


@query("SELECT type, count(*) AS n FROM msg WHERE type IN ('user', 'assistant', 'system') GROUP BY 1", P.MESSAGES)
def c1_valid_messages(spark, sf_dir):
    return messages.valid_messages(P.messages(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


@query('SELECT "S", ord FROM msg WHERE NOT is_sidechain', P.MESSAGES)
def c5_main_chain(spark, sf_dir):
    return messages.main_chain(P.messages(spark, sf_dir)).select("S", "ord")


@query("""SELECT "S", ord, CASE WHEN type <> 'user' THEN subtype WHEN ("S" + ord) % 9 = 0 THEN 'task-notification' WHEN ("S" + ord) % 9 = 1 THEN 'skill-output' WHEN ("S" + ord) % 9 IN (2, 6) THEN 'command-output'
 WHEN ("S" + ord) % 9 = 3 THEN 'system-reminder' ELSE subtype END AS subtype FROM marked""", P.MARKED)
def c4_message_subtype(spark, sf_dir):
    return P.marked(spark, sf_dir).select("S", "ord", T.message_subtype("type", "text", "subtype").alias("subtype"))


@query(f"""SELECT "S", ord, type = 'user' AND NOT {_SYS} AS is_real_user, type = 'user' AND {_SYS} AS system_generated FROM marked""", P.MARKED)
def c3_real_users(spark, sf_dir):
    return messages.classify(P.marked(spark, sf_dir)).select("S", "ord", "is_real_user", "system_generated")


@query("""SELECT "S", turn_count > 1 AS is_multi_turn FROM summary""", _SUMMARY)
def c6_turn_split(spark, sf_dir):
    return annotate.turn_split(_summary(spark, sf_dir)).select("S", "is_multi_turn")


@query("""SELECT "S", ord, regexp_replace(regexp_replace(text, '<system-reminder>(.|\\n)*?</system-reminder>\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM marked""", P.MARKED)
def b10_clean_user_text(spark, sf_dir):
    return P.marked(spark, sf_dir).select("S", "ord", T.clean_user_text("text").alias("text"))


@query("""SELECT "S", ord, CASE ("S" + ord) % 9 WHEN 2 THEN '/login' ELSE 'System' END AS label, CASE ("S" + ord) % 9 WHEN 2 THEN 'ok' ELSE 'careful note' END AS output FROM marked WHERE ("S" + ord) % 9 IN (2, 6)""", P.MARKED)
def b11_command_output(spark, sf_dir):
    label, out = T.command_output("text")
    m = P.marked(spark, sf_dir).where(T.message_subtype("type", "text", "subtype") == "command-output")
    return m.select("S", "ord", label.alias("label"), out.alias("output"))


@query("""SELECT "S", ord, generate_subscripts(p, 1) - 1 AS pos, trim(unnest(p)) AS path FROM (SELECT "S", ord, regexp_extract_all(text, '\\[Image: source: ([^\\]]+)\\]', 1) AS p FROM marked WHERE type = 'user')""", P.MARKED)
def b9_image_path_refs(spark, sf_dir):
    return messages.image_path_refs(P.marked(spark, sf_dir))


@query("""SELECT "S", ord, 0 AS pos, 0 AS i, path FROM calls WHERE message_type = 'user' OR name = 'Bash'""", P.CALLS)
def b9_part_image_path_refs(spark, sf_dir):
    return messages.part_image_path_refs(messages.explode_parts(P.acted(spark, sf_dir)))


@query("""SELECT "S", md5(arg_max(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ord)) AS digest FROM msg WHERE ("S" + ord) % 3 = 0 OR type = 'system' GROUP BY 1""", P.MESSAGES)
def b14_instruction_doc(spark, sf_dir):
    m = P.messages(spark, sf_dir).withColumns({"type": F.expr("if((S + ord) % 3 = 0, 'system', type)"), "text": F.concat(F.lit("x\nContents of /w/CLAUDE.md (of the project):\n"), "text", F.lit("\n\nContents of /w/b.md:\ny"))})
    return messages.instruction_doc(m).select("S", F.md5("doc").alias("digest"))


@query("""SELECT "S", ord, CASE WHEN name = 'Bash' THEN left('run ' || k || chr(10) || repeat('x', CAST(k AS INT)), 120) ELSE path END AS preview, '[' || name || '] ' || CASE WHEN name = 'Bash' THEN 'run ' || k ELSE path END AS line FROM calls""", P.CALLS)
def b12_tool_preview(spark, sf_dir):
    c = P.calls(spark, sf_dir)
    arg = {"command": F.concat(F.lit("run "), F.col("k").cast("string"), F.lit("\n"), F.expr("repeat('x', int(k))")), "file_path": F.col("path")}
    of = lambda f: arg.get(f, F.lit(None).cast("string"))
    return c.select("S", "ord", T.tool_preview("name", of).alias("preview"), T.tool_line("name", of).alias("line"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good ' || d.doc_id END, nullif(left(d.text, 20), ''), left(CAST(d.doc_id AS VARCHAR), 12)) AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def b13_display_title(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id", "left")
    custom = F.when(F.col("quality") == 1, F.concat(F.lit("good "), "doc_id"))
    return d.select("doc_id", messages.display_title(custom, F.left("text", F.lit(20)), F.col("doc_id").cast("string")).alias("title"))


@query("""SELECT "S", string_agg(event_type, ',' ORDER BY first_at) AS "values" FROM (SELECT "S", event_type, min(ord) AS first_at FROM calls GROUP BY 1, 2) GROUP BY 1""", P.CALLS)
def e3_distinct_in_order(spark, sf_dir):
    return summary.distinct_in_order(P.calls(spark, sf_dir), "event_type").select("S", F.array_join("values", ",").alias("values"))


@query('SELECT "S", name AS tool, count(*) AS n, min(ord) AS first_ord FROM calls WHERE message_type = \'assistant\' GROUP BY 1, 2', P.CALLS)
def e4_tool_usage(spark, sf_dir):
    return summary.tool_usage(P.calls(spark, sf_dir))


@query('SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "S" ORDER BY n DESC, first_ord, tool) AS rank FROM (SELECT "S", name AS tool, count(*) AS n, min(ord) AS first_ord FROM calls WHERE message_type = \'assistant\' GROUP BY 1, 2)) WHERE rank <= 2', P.CALLS)
def h2_top_tools(spark, sf_dir):
    return summary.top_tools(summary.tool_usage(P.calls(spark, sf_dir)), 2)


@query('SELECT "S", CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM usage WHERE type = \'assistant\' GROUP BY 1', P.USAGE)
def e5_token_totals(spark, sf_dir):
    return summary.token_totals(P.usage(spark, sf_dir))


@query('SELECT "S", turn_no, CAST(sum(input + cache_creation + cache_read) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM usage WHERE type = \'assistant\' GROUP BY 1, 2', P.USAGE)
def e6_turn_tokens(spark, sf_dir):
    return summary.turn_tokens(P.usage(spark, sf_dir))


_REFS = P.CALLS + """, refs AS (SELECT "S", path, array_to_string(list_sort(list_distinct(list(CASE WHEN message_type = 'user' OR name = 'Bash' THEN 'user-image' ELSE lower(name) END))), ',') AS actions, min(ord) AS first_ord FROM calls GROUP BY 1, 2)"""


def _refs(spark, sf_dir):
    return summary.session_file_actions(messages.explode_parts(P.acted(spark, sf_dir)))


@query("SELECT * FROM refs", _REFS)
def e8_file_actions(spark, sf_dir):
    return _refs(spark, sf_dir).withColumn("actions", F.array_join("actions", ","))


@query("SELECT \"S\", path FROM refs WHERE actions <> 'read'", _REFS)
def c7_notable_files(spark, sf_dir):
    return summary.notable_files(_refs(spark, sf_dir)).select("S", "path")


_INVENTORY = "inv AS (SELECT DISTINCT '/src/' || (page_id % 60) AS path FROM pages)"


def _inventory(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select(F.concat(F.lit("/src/"), F.expr("string(page_id % 60)")).alias("path"))


@query('SELECT "S", refs.path, inv.path IS NOT NULL AS exists FROM refs LEFT JOIN inv ON refs.path = inv.path', f"{_REFS}, {_INVENTORY}")
def d9_file_existence(spark, sf_dir):
    return summary.file_existence(_refs(spark, sf_dir), _inventory(spark, sf_dir)).select("S", "path", "exists")


@query("""SELECT "S", refs.path, row_number() OVER (PARTITION BY "S" ORDER BY inv.path IS NOT NULL DESC, CASE WHEN contains(actions, 'write') THEN 0 WHEN contains(actions, 'edit') THEN 1 ELSE 2 END, first_ord, refs.path) AS place FROM refs LEFT JOIN inv ON refs.path = inv.path""", f"{_REFS}, {_INVENTORY}")
def h3_file_order(spark, sf_dir):
    return summary.file_order(summary.file_existence(_refs(spark, sf_dir), _inventory(spark, sf_dir))).select("S", "path", "place")


@query("SELECT count(*) AS sessions, sum(length(text)) AS total FROM documents")
def e10_corpus_stats(spark, sf_dir):
    return summary.corpus_stats(P.read(spark, sf_dir, "documents").withColumn("n", F.length("text")), "n")


@query("""SELECT 'u' AS "S", '/' || array_to_string(s.q, '/') AS path, array_to_string(s.q[coalesce(f, 0) + 1:s.level], '/') AS name, CASE WHEN f > 0 THEN '/' || array_to_string(s.q[1:f], '/') END AS parent, coalesce(n.depth, 0) AS depth, is_file, n_files, n_existing,
 n_files - n_existing AS n_deleted, row_number() OVER (PARTITION BY CASE WHEN f > 0 THEN s.q[1:f] END ORDER BY least IS NULL, array_to_string(s.q[coalesce(f, 0) + 1:s.level], '/')) AS place FROM shown s LEFT JOIN near n ON n.q = s.q""",
 """own AS (SELECT p, bool_or(e) AS e FROM (SELECT list_filter(string_split(split_part(replace(url, 'http:/', ''), '?', 1), '/'), lambda y: y <> '') AS p, page_id % 3 > 0 AS e FROM pages) WHERE len(p) > 0 GROUP BY 1),
 up AS (SELECT p[1:d] AS q, d AS level, p[d + 1] AS child, e FROM (SELECT p, e, unnest(range(1, len(p) + 1)) AS d FROM own)),
 nodes AS (SELECT q, level, count(*) AS n_files, count(*) FILTER (e) AS n_existing, min(child) AS least, max(child) AS most, bool_or(child IS NULL) AS is_file FROM up GROUP BY 1, 2),
 shown AS (SELECT * FROM nodes WHERE is_file OR least <> most), ways AS (SELECT q, q[1:d] AS a, d FROM (SELECT q, unnest(range(1, level)) AS d FROM shown)),
 near AS (SELECT w.q, max(w.d) AS f, count(*) AS depth FROM ways w JOIN shown s ON s.q = w.a GROUP BY 1)""")
def e11_file_tree(spark, sf_dir):
    path = F.split_part(F.replace("url", F.lit("http:/"), F.lit("")), F.lit("?"), F.lit(1))
    return summary.file_tree(P.read(spark, sf_dir, "pages").select(F.lit("u").alias("S"), path.alias("path"), F.expr("page_id % 3 > 0").alias("exists")))


@query('SELECT "S", ord, coalesce(ord < max(CASE WHEN is_boundary THEN ord END) OVER (PARTITION BY "S"), false) AS is_pre_compact FROM msg', P.MESSAGES)
def f1_is_pre_compact(spark, sf_dir):
    return sequence.mark_pre_compact(P.messages(spark, sf_dir)).select("S", "ord", "is_pre_compact")


@query('SELECT "S", section_no, kind, n_users FROM lab', _SECTIONED)
def f2_sections(spark, sf_dir):
    return sequence.section_labels(_sectioned(spark, sf_dir), P.messages(spark, sf_dir))


@query("""SELECT "S", section_no, ord, turn_no, type = 'user' AS starts_turn FROM turned""", _SECTIONED)
def f3_turns(spark, sf_dir):
    return sequence.turns(_sectioned(spark, sf_dir)).select("S", "section_no", "ord", "turn_no", "starts_turn")


_ITEMS = P.CALLS + """, items AS (SELECT "S", 0 AS section_no, k % 3 AS turn_no, ord, 0 AS pos, CASE WHEN event_type = 'click' THEN 'text' ELSE 'tool' END AS kind FROM calls),
 opened AS (SELECT *, CASE WHEN kind = 'text' OR coalesce(lag(kind) OVER w = 'text', true) THEN 1 ELSE 0 END AS new FROM items WINDOW w AS (PARTITION BY "S", turn_no ORDER BY ord)),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY "S", turn_no ORDER BY ord) AS segment_no FROM opened)"""


@query('SELECT "S", section_no, turn_no, segment_no, any_value(kind) AS kind, min(ord) AS first_ord, count(*) AS n_items FROM numbered GROUP BY 1, 2, 3, 4', _ITEMS)
def f4_segments(spark, sf_dir):
    c = P.calls(spark, sf_dir)
    return sequence.segments(c.select("S", F.lit(0).alias("section_no"), (F.col("k") % 3).alias("turn_no"), "ord", F.lit(0).alias("pos"), F.when(F.col("event_type") == "click", "text").otherwise("tool").alias("kind")))


@query("""SELECT "S" AS branch, count(*) FILTER (side <> was) AS n FROM (SELECT *, lag(side) OVER (PARTITION BY "S" ORDER BY time, side, ord) AS was FROM (SELECT *, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS side FROM calls)) GROUP BY 1""", P.CALLS)
def f5_transitions(spark, sf_dir):
    c = P.calls(spark, sf_dir)
    return sequence.transitions(c.select(F.col("S").alias("branch"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("side"), F.col("time").alias("ts"), F.col("ord").alias("pos")))


_CLUSTERS = """r AS (SELECT o_custkey AS "S", o_orderkey AS file, CAST(o_orderdate AS TIMESTAMP) AS st, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 30 AS INT)) AS en FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY "S" ORDER BY st, en, file) AS i FROM r),
 fold AS (SELECT "S", i, file, 1 AS k, [en] AS ends FROM n WHERE i = 1 UNION ALL
  SELECT f."S", n.i, n.file, coalesce(nullif(list_position(list_transform(f.ends, lambda x: n.st >= x - INTERVAL 1 SECOND), true), 0), len(f.ends) + 1) AS k,
   CASE WHEN coalesce(nullif(list_position(list_transform(f.ends, lambda x: n.st >= x - INTERVAL 1 SECOND), true), 0), 0) = 0 THEN list_append(f.ends, n.en)
   ELSE list_transform(f.ends, lambda x, j: CASE WHEN j = list_position(list_transform(f.ends, lambda y: n.st >= y - INTERVAL 1 SECOND), true) THEN greatest(x, n.en) ELSE x END) END AS ends
  FROM fold f JOIN n ON n."S" = f."S" AND n.i = f.i + 1)"""


@query('SELECT "S", file, k - 1 AS cluster FROM fold', _CLUSTERS, True)
def f6_continuation_clusters(spark, sf_dir):
    return sequence.continuation_clusters(P.ranges(spark, sf_dir)).select("S", "file", "cluster")


@query('SELECT "S", k - 1 AS cluster, CASE WHEN count(*) OVER (PARTITION BY "S") > 1 THEN "S" || \':branch-\' || (k - 1) ELSE CAST("S" AS VARCHAR) END AS id, primary_file FROM (SELECT f."S", k, arg_max(f.file, (n.st, n.file)) AS primary_file FROM fold f JOIN n ON f."S" = n."S" AND f.i = n.i GROUP BY 1, 2)', _CLUSTERS, True)
def g8_cluster_rows(spark, sf_dir):
    return lineage.cluster_ids(sequence.continuation_clusters(P.ranges(spark, sf_dir)))


@query("""SELECT "S", row_number() OVER (PARTITION BY "S" ORDER BY section_no, ord) AS place, level, title FROM (
 SELECT l."S", section_no, -1 AS ord, 2 AS level, kind AS title FROM lab l JOIN (SELECT "S", count(*) AS n FROM lab GROUP BY 1) c ON l."S" = c."S" WHERE kind <> 'current' OR n > 1 UNION ALL
 SELECT "S", section_no, ord, 5, left(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), 1), 50) FROM turned WHERE type = 'user')""", _SECTIONED)
def f7_chat_toc(spark, sf_dir):
    s = _sectioned(spark, sf_dir)
    return sequence.chat_toc(s, sequence.turns(s), sequence.section_labels(s, P.messages(spark, sf_dir)))


@query("SELECT * FROM toc", P.DOCS)
def f8_heading_toc(spark, sf_dir):
    return sequence.heading_toc(P.marked_docs(spark, sf_dir))


@query("""SELECT f.id, f.n, f.line, f.h AS is_heading, t.slug FROM (SELECT *, CASE WHEN h THEN sum(CAST(h AS INT)) OVER (PARTITION BY id ORDER BY n) END AS i FROM (SELECT *, NOT in_code AND regexp_matches(line, '^#{1,6} ') AS h FROM fenced)) f
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM toc) t ON f.id = t.id AND f.i = t.i""", P.DOCS)
def f9_source_lines(spark, sf_dir):
    return sequence.source_lines(P.marked_docs(spark, sf_dir))


_BOLD = "CASE WHEN NOT in_code AND regexp_matches(line, '^#{1,6}\\s+[^\\r]+$') THEN '**' || replace(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1), '**', '') || '**' ELSE line END"


@query(f"SELECT id, md5(string_agg({_BOLD}, chr(10) ORDER BY n)) AS digest FROM fenced GROUP BY 1", P.DOCS)
def f10_demote_headings(spark, sf_dir):
    return sequence.demote_headings(P.marked_docs(spark, sf_dir)).select("id", F.md5("text").alias("digest"))


@query('SELECT CAST("S" AS VARCHAR) AS "S", CAST(rn AS VARCHAR) AS node FROM leaf', P.TREE, True)
def g1_leaves(spark, sf_dir):
    return lineage.leaves(lineage.edges(P.tree(spark, sf_dir))).select("S", "node")


@query('SELECT CAST("S" AS VARCHAR) AS "S", CAST(start AS VARCHAR) AS start, CAST(node AS VARCHAR) AS node, CAST(distance AS BIGINT) AS distance FROM path', P.TREE, True)
def g2_ancestors(spark, sf_dir):
    e = lineage.edges(P.tree(spark, sf_dir))
    return lineage.ancestors(e, lineage.leaves(e))


@query("""SELECT CAST(p."S" AS VARCHAR) AS "S", CAST(start AS VARCHAR) AS start, count(*) AS message_count, least(count(*) FILTER (event_type IN ('click', 'view')), count(*) FILTER (event_type NOT IN ('click', 'view'))) AS turn_count FROM path p JOIN tree t ON p."S" = t."S" AND p.node = t.rn GROUP BY 1, 2""", P.TREE, True)
def e12_path_turn_counts(spark, sf_dir):
    forest = lineage.plant(P.tree(spark, sf_dir))
    return lineage.path_turn_counts(forest, forest.nodes.where("is_leaf"))


_BRANCHES = P.TREE + """, facts AS (SELECT user_id AS "S", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, ts, event_type IN ('click', 'view') AS by_user, trim(event_type || props) AS text FROM events),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY "S" ORDER BY length DESC, start) AS rank FROM (SELECT "S", start, count(*) AS length FROM path GROUP BY 1, 2)),
 main AS (SELECT p.*, r.length FROM path p JOIN ranked r ON r."S" = p."S" AND r.start = p.start WHERE rank = 1),
 placed AS (SELECT p."S", p.start, p.node, p.distance, r.length, r.rank, m.distance AS on_main, m.length AS main_length FROM path p JOIN ranked r ON r."S" = p."S" AND r.start = p.start AND r.rank > 1 LEFT JOIN main m ON m."S" = p."S" AND m.node = p.node),
 side AS (SELECT p."S", p.start, length, rank, count(on_main) AS common, max(main_length) AS main_length, arg_min(node, on_main) FILTER (on_main IS NOT NULL) AS point, min(on_main) AS fork,
  count(*) FILTER (on_main IS NULL AND by_user) AS users, arg_max(left(text, 200), p.distance) FILTER (on_main IS NULL AND by_user) AS first_user_message FROM placed p JOIN facts f ON f."S" = p."S" AND f.rn = p.node GROUP BY 1, 2, 3, 4),
 longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "S", point, left(first_user_message, 60) ORDER BY rank) AS nth FROM side WHERE first_user_message IS NOT NULL) WHERE nth = 1 AND common BETWEEN 1 AND main_length - 1 AND users > 0),
 timed AS (SELECT l."S", l.start, 1 AS side, f.ts, -p.distance AS pos FROM longest l JOIN placed p ON p."S" = l."S" AND p.start = l.start AND on_main IS NULL JOIN facts f ON f."S" = p."S" AND f.rn = p.node
  UNION ALL SELECT l."S", l.start, 0, f.ts, -m.distance FROM longest l JOIN main m ON m."S" = l."S" AND m.distance < l.fork JOIN facts f ON f."S" = m."S" AND f.rn = m.node),
 swaps AS (SELECT "S", start, count(*) FILTER (side <> was) AS n FROM (SELECT *, lag(side) OVER (PARTITION BY "S", start ORDER BY ts, side, pos) AS was FROM timed) GROUP BY 1, 2)"""


@query("""SELECT CAST(l."S" AS VARCHAR) AS "S", row_number() OVER (PARTITION BY l."S" ORDER BY rank) - 1 AS branch_no, CAST(l.start AS VARCHAR) AS leaf, CAST(point AS VARCHAR) AS point, first_user_message, length AS path_length, common FROM longest l JOIN swaps w ON w."S" = l."S" AND w.start = l.start WHERE n >= 3""", _BRANCHES, True)
def g4_branches(spark, sf_dir):
    return lineage.detect_branches(P.tree(spark, sf_dir))


@query('SELECT CAST(p."S" AS VARCHAR) AS "S", CAST(node AS VARCHAR) AS uuid FROM path p WHERE start = (SELECT max(rn) FROM leaf l WHERE l."S" = p."S")', P.TREE, True)
def g3_branch_messages(spark, sf_dir):
    m = P.tree(spark, sf_dir)
    leaf = lineage.leaves(lineage.edges(m)).groupBy("S").agg(F.max_by("node", "ord").alias("node"))
    return lineage.branch_messages(m, leaf).select("S", "uuid")


@query('SELECT "S", ord, coalesce(ord <= 2, false) AS is_shared FROM msg m WHERE EXISTS (SELECT 1 FROM msg p WHERE p."S" = m."S" AND p.ord = 2) UNION ALL SELECT "S", ord, false FROM msg m WHERE NOT EXISTS (SELECT 1 FROM msg p WHERE p."S" = m."S" AND p.ord = 2)', P.MESSAGES)
def g7_branch_split(spark, sf_dir):
    m = P.messages(spark, sf_dir)
    return lineage.branch_split(m, m.select("S", F.concat_ws("-", "S", F.lit(2)).alias("point")).distinct()).select("S", "ord", "is_shared")


@query("""SELECT 'f' || "S" AS file, "S", "S" - 3 AS parent_S, 'x' || "S" AS point FROM (SELECT DISTINCT "S" FROM msg) a WHERE "S" % 3 = 0 AND EXISTS (SELECT 1 FROM msg b WHERE b."S" = a."S" - 3)""", P.MESSAGES)
def d6_fork_links(spark, sf_dir):
    m = P.messages(spark, sf_dir).withColumns({"file": F.concat(F.lit("f"), "S"), "fork_session": F.expr("if(S % 3 = 0, S - 3, null)"), "fork_message": F.concat(F.lit("x"), "S")})
    return lineage.fork_links(m, m).select("file", "S", "parent_S", "point")


_HITS = P.MESSAGES + """, hits AS (SELECT *, instr(lower(text), 'en ') AS p FROM msg WHERE type IN ('user', 'assistant') AND instr(lower(text), 'en ') > 0)"""


def _hits(spark, sf_dir):
    return search.search(P.messages(spark, sf_dir).where("type in ('user', 'assistant')"), "EN ", "text")


_SNIPPETS = """SELECT "S", ord, CASE WHEN p > 61 THEN '...' ELSE '' END || substring(text, greatest(p - 60, 1), p + 63 - greatest(p - 60, 1)) || CASE WHEN p + 63 <= length(text) THEN '...' ELSE '' END AS snippet
 FROM (SELECT "S", ord, text, length(regexp_extract(text, '(?is)^(.*?)en ', 1)) + 1 AS p FROM (SELECT * REPLACE (CASE WHEN ord % 2 = 1 THEN repeat(chr(304), 70) || text ELSE text END AS text) FROM hits))"""


@query(_SNIPPETS, _HITS)
def k2_search(spark, sf_dir):
    """Every second text begins with characters that are longer in lower case."""
    m = P.messages(spark, sf_dir).where("type in ('user', 'assistant')").withColumn("text", F.expr("if(ord % 2 = 1, concat(repeat('\u0130', 70), text), text)"))
    return search.search(m, "EN ", "text").select("S", "ord", "snippet")


@query(_SNIPPETS, _HITS)
def k2_indexed_search(spark, sf_dir):
    """The same rows by way of an index, which is built first."""
    m = P.messages(spark, sf_dir).where("type in ('user', 'assistant')").withColumn("text", F.expr("if(ord % 2 = 1, concat(repeat('\u0130', 70), text), text)"))
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search_index.build_index(m, path, ("S", "ord"), "text")
    return search_index.search_indexed(spark, path, "EN ", "text").select("S", "ord", "snippet")


@query('SELECT "S", count(*) AS n_hits, arg_min(ts, ord) AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY "S" ORDER BY ord) AS nth FROM hits) WHERE nth <= 3 GROUP BY 1', _HITS)
def k3_search_ranked(spark, sf_dir):
    return search.result_order(search.search_ranked(_hits(spark, sf_dir), "S", 3)[1], "S")


@query('SELECT count(DISTINCT "S") AS files, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY "S" ORDER BY ord) AS nth FROM hits) WHERE nth <= 3', _HITS)
def e10_search_totals(spark, sf_dir):
    return search.search_totals(search.search_ranked(_hits(spark, sf_dir), "S", 3)[0], "S")


@query("""SELECT 'f' || "S" AS file, "S", left(coalesce(arg_min(text, ord) FILTER (type = 'user'), ''), 200) AS first_user_message FROM msg GROUP BY "S" """, P.MESSAGES)
def k4_search_header(spark, sf_dir):
    return search.search_header(P.messages(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), "S")))


@query("""SELECT "S", section_no, count(*) AS hits, CAST(sum(len(list_filter(range(1, length(text)), lambda i: lower(substring(text, i, 2)) = 'en'))) AS BIGINT) AS occurrences FROM sec WHERE instr(lower(text), 'en') > 0 GROUP BY 1, 2""", _SECTIONED)
def k5_search_in_session(spark, sf_dir):
    return search.search_in_session(_sectioned(spark, sf_dir), " en ")


@query("""SELECT c."S", c.ord, c.id, CASE WHEN c.nth = 1 THEN r.result END AS result FROM (SELECT "S", ord, k AS id, row_number() OVER (PARTITION BY "S", k ORDER BY ord) AS nth FROM calls WHERE event_type = 'click') c
 LEFT JOIN (SELECT "S", k AS id, arg_max('r' || ord, ord) AS result FROM calls WHERE event_type = 'view' GROUP BY 1, 2) r ON c."S" = r."S" AND c.id = r.id""", P.CALLS)
def d1_pair_tool_results(spark, sf_dir):
    c = P.calls(spark, sf_dir).withColumns({"id": F.col("k"), "pos": F.lit(0)})
    results = c.where("event_type = 'view'").select("S", "ord", "pos", "id", F.concat(F.lit("r"), "ord").alias("result"))
    return messages.pair_tool_results(c.where("event_type = 'click'").select("S", "ord", "pos", "id"), results).select("S", "ord", "id", "result")


_ROWS = """rows_ AS (SELECT 'd' || doc_id AS id, 'd' || (doc_id // 2) AS "S", doc_id % 5 = 0 AS is_branch FROM documents), meta AS (SELECT 'd' || doc_id AS id, 't' || doc_id AS custom_title, 'q' || quality AS notes FROM labels)"""


def _rows(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("d"), F.expr("doc_id div 2")).alias("S"), F.expr("doc_id % 5 = 0").alias("is_branch"))


def _meta(spark, sf_dir):
    return P.read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("t"), "doc_id").alias("custom_title"), F.concat(F.lit("q"), "quality").alias("notes"))


@query("""SELECT r.id, CASE WHEN is_branch OR s.id IS NULL THEN i.custom_title ELSE s.custom_title END AS custom_title FROM rows_ r LEFT JOIN meta s ON s.id = r."S" LEFT JOIN meta i ON i.id = r.id""", _ROWS)
def d2_attach_meta(spark, sf_dir):
    return annotate.attach_meta(_rows(spark, sf_dir), _meta(spark, sf_dir)).select("id", "custom_title")


@query('SELECT id FROM rows_ r WHERE id NOT IN (SELECT id FROM meta) AND (is_branch OR "S" NOT IN (SELECT id FROM meta))', _ROWS)
def d3_ungrouped(spark, sf_dir):
    return annotate.ungrouped(_rows(spark, sf_dir), _meta(spark, sf_dir).select(F.col("id").alias("member_id"))).select("id")


_SESSIONS = P.FOLDERS + """, s AS (SELECT 'c' || o_custkey AS "S", min('o' || o_orderkey) AS id FROM orders GROUP BY 1)"""


def _orders(spark, sf_dir):
    return P.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("S"), F.concat(F.lit("o"), "o_orderkey").alias("id"))


@query("""SELECT f.id AS folder_id, coalesce(o.n, 0) AS own, CAST(coalesce(o.n, 0) + coalesce(b.n, 0) AS BIGINT) AS total FROM folders f LEFT JOIN (SELECT folder_id, count(*) AS n FROM members m JOIN s ON s."S" = m.member_id GROUP BY 1) o ON o.folder_id = f.id
 LEFT JOIN (SELECT parent_id, count(*) AS n FROM folders JOIN members ON folder_id = id GROUP BY 1) b ON b.parent_id = f.id""", _SESSIONS)
def d4_folder_totals(spark, sf_dir):
    return annotate.folder_totals(*P.folders(spark, sf_dir), _orders(spark, sf_dir))


@query("""SELECT DISTINCT folder_id, member_id FROM (SELECT * FROM members UNION ALL SELECT 'n' || (o_orderkey % 40), 'o' || o_orderkey FROM orders WHERE 'n' || (o_orderkey % 40) IN (SELECT id FROM folders))""", P.FOLDERS)
def d5_inject_branch_members(spark, sf_dir):
    f, m = P.folders(spark, sf_dir)
    placed = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("n"), F.expr("o_orderkey % 40")).alias("folder_id"), F.concat(F.lit("o"), "o_orderkey").alias("member_id"))
    return annotate.inject_branch_members(m, placed, f)


@query('SELECT r.id, coalesce(o.notes, s.notes) AS export_path FROM rows_ r LEFT JOIN meta o ON o.id = r.id LEFT JOIN meta s ON s.id = r."S"', _ROWS)
def d12_attach_export_paths(spark, sf_dir):
    return annotate.attach_export_paths(_rows(spark, sf_dir), _meta(spark, sf_dir).select("id", F.col("notes").alias("path"))).select("id", "export_path")


@query("""SELECT r.id, CASE WHEN p.id IS NOT NULL THEN coalesce(m.custom_title, left(p.id, 12)) END AS parent_title, (SELECT count(*) FROM rows_ c WHERE c."S" = r.id) AS n_children FROM rows_ r LEFT JOIN rows_ p ON p.id = r."S" LEFT JOIN meta m ON m.id = p.id""", _ROWS)
def d13_branch_neighbours(spark, sf_dir):
    s = _rows(spark, sf_dir).join(_meta(spark, sf_dir), "id", "left").withColumns({"parent_id": F.col("S"), "first_user_message": F.lit("")})
    return annotate.branch_neighbours(s)


@query("SELECT * FROM closure", P.DEEP, True)
def m1_folder_closure(spark, sf_dir):
    return annotate.folder_closure(P.deep_folders(spark, sf_dir)[0])


@query("SELECT id, CASE WHEN k >= 20 AND k % 7 = 3 OR k = 9 THEN 'c2' WHEN k = 12 THEN NULL WHEN k = 6 THEN 'c7' WHEN k = 13 THEN 'c10' WHEN k = 10 THEN 'c1' ELSE parent_id END AS parent_id FROM deep", P.DEEP, True)
def m2_apply_folder_moves(spark, sf_dir):
    """Many folders move under c2 and some elsewhere; under an own descendant, itself and nowhere known are refused, in the order of the moves:

    c6 goes under c7, so c7 can't go under c6 any more; c10 goes away and comes back under c1 after c13 went under it.
    """
    f = P.deep_folders(spark, sf_dir)[0]
    to = F.expr("case when k >= 20 and k % 7 = 3 or k = 9 then 'c2' when k = 1 then 'c30' when k = 4 then 'c4' when k = 5 then 'gone' end")
    many = f.where("k >= 20 and k % 7 = 3 or k in (1, 4, 5, 9, 12)").select("id", to.alias("parent_id"), F.lit(1).alias("seq"))
    more = [("c6", "c7", 2), ("c7", "c6", 3), ("c10", "c8", 4), ("c13", "c10", 5), ("c10", "c13", 6), ("c10", "c1", 7), ("nobody", "c1", 8)]
    return annotate.apply_folder_moves(f, many.unionByName(spark.createDataFrame(more, "id string, parent_id string, seq int"))).select("id", "parent_id")


@query("SELECT 'c' || o_custkey AS folder_id, 'o' || o_orderkey AS member_id FROM orders WHERE 'c' || o_custkey NOT IN (SELECT descendant FROM closure WHERE ancestor IN ('c3', 'c8'))", P.DEEP, True)
def m3_delete_folders(spark, sf_dir):
    f, m = P.deep_folders(spark, sf_dir)
    return annotate.delete_folders(f, m, f.where("id in ('c3', 'c8')"))[1].select("folder_id", "member_id")


@query("""SELECT DISTINCT folder_id, member_id FROM (SELECT * FROM members WHERE member_id NOT IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderkey % 3 > 0) UNION ALL
 SELECT arg_max('n' || (o_orderkey % 25), o_orderkey), 'c' || o_custkey FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey UNION ALL
 SELECT 'n' || (o_orderkey % 25), 'c' || o.o_custkey FROM orders o LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_move FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) m ON m.o_custkey = o.o_custkey WHERE o_orderkey % 3 = 0 AND (last_move IS NULL OR o_orderkey > last_move))""", P.FOLDERS)
def m4_assign_sessions(spark, sf_dir):
    changes = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("member_id"), F.concat(F.lit("n"), F.expr("o_orderkey % 25")).alias("folder_id"), F.expr("if(o_orderkey % 3 > 0, 'move', 'add')").alias("mode"), F.col("o_orderkey").alias("seq"))
    return annotate.assign_sessions(P.folders(spark, sf_dir)[1], changes)


@query("""SELECT coalesce(m.id, p.id) AS id, CASE WHEN p.id IS NOT NULL AND p.k % 2 = 0 THEN 'p' || p.k ELSE m.custom_title END AS custom_title, CASE WHEN p.id IS NOT NULL AND p.k % 3 = 0 THEN NULL ELSE m.notes END AS notes FROM meta m FULL JOIN (SELECT 'd' || doc_id AS id, doc_id AS k FROM documents WHERE source = 'src1') p ON m.id = p.id""", _ROWS)
def m6_patch_meta(spark, sf_dir):
    p = P.read(spark, sf_dir, "documents").where("source = 'src1'").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("p"), "doc_id").alias("custom_title"), F.lit(None).cast("string").alias("notes"), F.expr("doc_id % 2 = 0").alias("has_custom_title"), F.expr("doc_id % 3 = 0").alias("has_notes"))
    return annotate.patch_meta(_meta(spark, sf_dir), p)


@query("""SELECT page_id, CASE WHEN starts_with(url, 'http://ththre.example.com/') THEN 'https://new/' || substring(url, 27) ELSE url END AS url FROM pages""")
def m8_rename_paths(spark, sf_dir):
    return annotate.rename_paths(P.read(spark, sf_dir, "pages").select("page_id", "url"), "http://ththre.example.com", "https://new", "url")


@query("""SELECT id, CASE WHEN n > 1 THEN base || ' (' || n || ')' ELSE base END AS safe_name FROM (SELECT id, base, row_number() OVER (PARTITION BY source, base ORDER BY id) AS n FROM (SELECT doc_id AS id, source, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(split_part(text, '.', 1), '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 60), ''), 'untitled') AS base FROM documents))""")
def m9_unique_names(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"), F.split_part("text", F.lit("."), F.lit(1)).alias("name"))
    return annotate.unique_names(d).select("id", "safe_name")


@query("""SELECT id, given[len(given)] AS safe_name FROM walk WHERE n > 0""", """named AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CASE doc_id % 5 WHEN 0 THEN 'a (2)' WHEN 1 THEN 'b' WHEN 2 THEN 'a (3) (2)' WHEN 3 THEN 'a (3)' ELSE 'a' END AS base FROM documents),
 walk AS (SELECT source, 0::bigint AS n, NULL::bigint AS id, []::varchar[] AS given FROM named GROUP BY 1 UNION ALL
 SELECT w.source, m.n, m.id, list_append(w.given, CASE WHEN NOT list_contains(w.given, m.base) THEN m.base ELSE m.base || ' (' || list_filter(range(2, m.n + 2), lambda k: NOT list_contains(w.given, m.base || ' (' || k || ')'))[1] || ')' END) FROM walk w JOIN named m ON m.source = w.source AND m.n = w.n + 1)""", True)
def m9_names_with_numbers(spark, sf_dir):
    """Names that bring numbers in brackets of their own."""
    base = F.expr("case doc_id % 5 when 0 then 'a (2)' when 1 then 'b' when 2 then 'a (3) (2)' when 3 then 'a (3)' else 'a' end")
    d = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent"), base.alias("name"))
    return annotate.unique_names(d).select("id", "safe_name")


_PLACED = P.DEEP + """, base AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY k % 4 <> 1, CASE WHEN k % 4 = 1 THEN -k END, name, id) AS spot FROM deep)"""


def _order(folders):
    return folders.where("k % 4 = 1").select("id", (-F.col("k")).alias("pos"))


@query("SELECT id, spot AS place FROM base", _PLACED, True)
def h4_folder_order(spark, sf_dir):
    f = P.deep_folders(spark, sf_dir)[0]
    return annotate.folder_order(f, _order(f)).select("id", "place")


@query("""SELECT "S", md5('# s' || "S" || chr(10) || chr(10) || '> ' || strftime(CAST(created_at AS TIMESTAMP), '%-m/%-d %H:%M') || ' | ' || turn_count || ' turns' || chr(10) || coalesce(chr(10) || body, '')) AS digest FROM summary LEFT JOIN
 (SELECT "S" AS s2, string_agg(CASE type WHEN 'user' THEN '**User** [' ELSE '**Assistant** [' END || strftime(CAST(ts AS TIMESTAMP), '%-m/%-d %H:%M') || ']' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10), chr(10) ORDER BY ord) AS body FROM m
 WHERE type IN ('user', 'assistant') AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1) ON s2 = "S" """, _SUMMARY)
def n1_transcript_compact(spark, sf_dir):
    m = _messages(spark, sf_dir)
    head = summary.session_summary(m).select("S", F.concat(F.lit("s"), "S").alias("title"), "created_at", "turn_count", F.lit(None).cast("string").alias("tools"))
    return export.transcript_compact(m, head).select("S", F.md5("markdown").alias("digest"))


_TRANSCRIPT = _SUMMARY + _SECTIONED.removeprefix(_CLASSED) + f""", said AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, strftime(CAST(ts AS TIMESTAMP), '%-m/%-d %H:%M') AS stamp FROM turned WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
 pieces AS (SELECT "S", ord, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM said),
 coded AS (SELECT *, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY "S", ord ORDER BY n) % 2 = 1 OR starts_with(line, '```') AS in_code FROM pieces),
 bold AS (SELECT "S", ord, string_agg({_BOLD}, chr(10) ORDER BY n) AS plain, string_agg('> ' || {_BOLD}, chr(10) ORDER BY n) AS quoted FROM coded GROUP BY 1, 2),
 rows_ AS (SELECT "S", -1 AS section_no, -1 AS ord, 0 AS pos, '# ' || left(first_user_message, 60) || chr(10) || chr(10) || '> ' || strftime(CAST(created_at AS TIMESTAMP), '%-m/%-d %H:%M') || ' | ' || turn_count || ' turns' || chr(10) AS x FROM summary
  UNION ALL SELECT l."S", section_no, -1, 0, '## ' || kind || chr(10) FROM lab l JOIN (SELECT "S", count(*) AS n FROM lab GROUP BY 1) c ON c."S" = l."S" WHERE kind <> 'current' OR n > 1
  UNION ALL SELECT s."S", section_no, s.ord, 0, CASE WHEN type = 'user' THEN '##### ' || left(split_part(t, chr(10), 1), 50) || CASE WHEN length(t) > length(left(split_part(t, chr(10), 1), 50)) THEN '...' ELSE '' END || chr(10) || chr(10) || '*' || stamp || '*' || chr(10) || chr(10) || quoted || chr(10)
   ELSE plain || chr(10) END FROM said s JOIN bold b ON b."S" = s."S" AND b.ord = s.ord
  UNION ALL SELECT "S", section_no, max(ord), 1, '---' || chr(10) FROM said GROUP BY "S", section_no, turn_no)"""


@query("""SELECT "S", md5(string_agg(x, chr(10) ORDER BY section_no, ord, pos)) AS digest FROM rows_ GROUP BY 1""", _TRANSCRIPT)
def n2_transcript_full(spark, sf_dir):
    m, s = _messages(spark, sf_dir), _sectioned(spark, sf_dir)
    head = summary.session_summary(m).select("S", F.left("first_user_message", F.lit(60)).alias("title"), "created_at", "turn_count")
    return export.transcript_full(sequence.turns(s), head, sequence.section_labels(s, m)).select("S", F.md5("markdown").alias("digest"))


@query("""SELECT "S", section_no, turn_no, ord, type FROM turned WHERE turn_no > 0 AND ((turn_no % 2 = 1 AND type = 'user') OR (turn_no % 3 = 1 AND type = 'assistant'))""", _SECTIONED)
def n3_export_selection(spark, sf_dir):
    t = sequence.turns(_sectioned(spark, sf_dir))
    picks = t.where("turn_no > 0").select("S", "section_no", "turn_no").distinct().withColumns({"question": F.expr("turn_no % 2 = 1"), "answer": F.expr("turn_no % 3 = 1")})
    return export.export_selection(t, picks).drop("text")


@query("""SELECT "S", 'transcript-' || left(created_at, 10) || '-' || left(regexp_replace(coalesce(nullif(left(first_user_message, 30), ''), 's' || "S"), '[^a-zA-Z0-9一-鿿_-]', '_', 'g'), 30) AS name FROM summary""", _SUMMARY)
def n4_export_filename(spark, sf_dir):
    return _summary(spark, sf_dir).select("S", export.export_filename(F.col("created_at"), F.col("first_user_message"), F.concat(F.lit("s"), "S")).alias("name"))


@query("""SELECT 'o' || o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 4 < 3""")
def a2_manifest_diff(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("size"), F.expr("o_orderkey % 4").alias("k"))
    old, new = o.where("k <> 0"), o.where("k <> 1").withColumn("size", F.when(F.col("k") == 2, F.col("size") + 1).otherwise(F.col("size")))
    from talkweave.sources.logs import manifest_diff

    return manifest_diff(old.drop("k"), new.drop("k"))


@query("""SELECT n.id FROM (SELECT 'c' || o_custkey AS id, max(o_orderdate) AS newest FROM orders GROUP BY 1) n LEFT JOIN (SELECT 'c' || o_custkey AS id, max(o_orderdate) AS written FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) w ON n.id = w.id WHERE written IS NULL OR newest > written""")
def a6_stale_exports(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_orderdate").alias("mtime"), "o_orderkey")
    return export.stale_exports(o, o.where("o_orderkey % 2 = 0").groupBy("id").agg(F.max("mtime").alias("mtime")))


@query("""SELECT 'o' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'new' WHEN 2 THEN 'old' ELSE 'new' END AS title, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS updated_at, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE 'b' END AS sources FROM orders""")
def a7_session_registry(spark, sf_dir):
    """By order key: only known before; only new; the same time and no title; a later time and a title."""
    o = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.expr("o_orderkey % 4").alias("k"))
    old = o.where("k <> 1").select("id", F.lit("old").alias("title"), F.lit(1).alias("updated_at"), F.lit("a").alias("sources"))
    new = o.where("k <> 0").select("id", F.when(F.col("k") == 2, "").otherwise("new").alias("title"), F.when(F.col("k") == 2, 1).otherwise(2).alias("updated_at"), F.lit("b").alias("sources"))
    return export.upsert_session_registry(old, new)


@query("""SELECT "S", min(time) AS first, max(time) + INTERVAL 2 HOUR AS until, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY "S" ORDER BY time, ord) AS spell FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY "S" ORDER BY time, ord) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM calls)) GROUP BY "S", spell""", P.CALLS)
def l3_active_sessions(spark, sf_dir):
    return live.active_sessions(P.calls(spark, sf_dir), "2 hours")


@query("""SELECT coalesce(a."S", b."S") AS "S", CASE WHEN b."S" IS NULL THEN 'idle' ELSE 'active' END AS change FROM (SELECT DISTINCT "S" FROM calls WHERE k < 2) a FULL JOIN (SELECT DISTINCT "S" FROM calls WHERE k BETWEEN 1 AND 2) b ON a."S" = b."S" WHERE a."S" IS NULL OR b."S" IS NULL""", P.CALLS)
def l4_active_changes(spark, sf_dir):
    c = P.calls(spark, sf_dir)
    return live.active_changes(c.where("k < 2").select("S").distinct(), c.where("k between 1 and 2").select("S").distinct())


def _parts(spark, sf_dir):
    return messages.explode_parts(P.contents(spark, sf_dir))


@query("""SELECT "S", ord, pos, kind FROM con, (VALUES (0, 'text'), (1, 'tool_use'), (2, 'tool_result'), (3, 'image')) v(pos, kind) WHERE is_array""", P.CONTENTS)
def b2_explode_parts(spark, sf_dir):
    return _parts(spark, sf_dir).select("S", "ord", "pos", messages.field("type").alias("kind"))


@query('SELECT "S", ord, text FROM con', P.CONTENTS)
def b3_extract_text(spark, sf_dir):
    return messages.extract_text(P.contents(spark, sf_dir).drop("text")).select("S", "ord", "text")


@query('SELECT "S", ord, uuid AS id, tool AS name FROM con WHERE is_array', P.CONTENTS)
def b4_tool_calls(spark, sf_dir):
    return messages.tool_calls(_parts(spark, sf_dir)).select("S", "ord", "id", "name")


@query("""SELECT "S", ord, uuid AS id, CASE "S" % 3 WHEN 0 THEN 'p' || "S" || chr(10) || 'q' ELSE 'r' || ord END AS result FROM con WHERE is_array AND type = 'user' AND "S" % 3 <> 1""", P.CONTENTS)
def b5_tool_results(spark, sf_dir):
    return messages.tool_results(_parts(spark, sf_dir)).select("S", "ord", "id", "result")


@query("""SELECT "S", ord, 3 AS pos, 'image/png' AS media_type, CAST(ord + 1 AS INT) AS n_chars FROM con WHERE is_array UNION ALL SELECT "S", ord, 2, 'image/png', 2 FROM con WHERE is_array AND "S" % 3 = 0""", P.CONTENTS)
def b6_inline_images(spark, sf_dir):
    return messages.inline_images(_parts(spark, sf_dir)).select("S", "ord", "pos", "media_type", "n_chars")


@query("""SELECT "S", turn_no AS ord, input, output FROM usage WHERE turn_no % 2 = 1""", P.USAGE)
def b7_token_usage(spark, sf_dir):
    counted = F.when(F.col("turn_no") % 2 == 1, F.struct("input", "output")).alias("usage")
    return messages.token_usage(P.usage(spark, sf_dir).select("S", F.lit("f").alias("file"), F.col("turn_no").alias("ord"), F.lit("assistant").alias("type"), counted)).drop("file", "type")


@query("""SELECT "S", ord, CASE WHEN "S" % 2 = 0 THEN 'unknown' ELSE 's' || ord END AS skill, ts, 'a' || ord AS args FROM con WHERE is_array AND tool = 'Skill' AND type = 'assistant'""", P.CONTENTS)
def b8_skill_invocations(spark, sf_dir):
    return messages.skill_invocations(messages.tool_calls(_parts(spark, sf_dir))).select("S", "ord", "skill", "ts", "args")


@query("""SELECT "S", ord, side, line_no, CASE line WHEN 'old' THEN 'old' || ord WHEN 'new' THEN 'new' || "S" ELSE line END AS line FROM con, (VALUES ('-', 0, 'old'), ('-', 1, 'more'), ('+', 0, 'new')) v(side, line_no, line) WHERE is_array AND tool = 'Edit'""", P.CONTENTS)
def b15_edit_lines(spark, sf_dir):
    return messages.edit_lines(messages.tool_calls(_parts(spark, sf_dir))).drop("pos")


@query("""SELECT "S", ord, file FROM con WHERE NOT contains(file, '/subagents/')""", P.CONTENTS)
def c2_exclude_subagents(spark, sf_dir):
    return logs.exclude_subagents(P.contents(spark, sf_dir)).select("S", "ord", "file")


@query(f"""SELECT "S", ord, type = 'user' AND (is_array OR {_SYS}) AS system_generated FROM con""", P.CONTENTS)
def c8_system_generated(spark, sf_dir):
    return messages.enrich(P.contents(spark, sf_dir)).select("S", "ord", "system_generated")


@query("""SELECT "S", count(*) AS n_images FROM con WHERE is_array AND type = 'user' GROUP BY 1""", P.CONTENTS)
def e7_pasted_image_count(spark, sf_dir):
    return messages.pasted_image_count(_parts(spark, sf_dir))


@query("""SELECT "S", 0 AS section_no, k % 3 AS turn_no, k % 2 AS segment_no, name AS tool, count(*) AS n, min(ord) AS first_ord FROM calls WHERE event_type <> 'click' GROUP BY 1, 3, 4, 5""", P.CALLS)
def e9_segment_tool_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "text").otherwise("tool").alias("kind")
    c = P.calls(spark, sf_dir).select("S", F.lit(0).alias("section_no"), (F.col("k") % 3).alias("turn_no"), (F.col("k") % 2).alias("segment_no"), "ord", F.col("name").alias("tool"), kind)
    return sequence.segment_tool_counts(c)


@query("""SELECT CAST(f."S" AS VARCHAR) AS "S", f.cluster, CAST(f.point AS VARCHAR) AS point, o.cluster AS parent_cluster FROM (SELECT "S", cluster, arg_min(parent, rn) AS point FROM clustered WHERE parent IS NOT NULL GROUP BY 1, 2) f
 JOIN clustered o ON o."S" = f."S" AND o.rn = f.point WHERE o.cluster <> f.cluster""", P.TREE + ", clustered AS (SELECT *, CAST(CASE WHEN rn <= 10 THEN 0 ELSE 1 + (rn - 11) % 3 END AS INT) AS cluster FROM tree)", True)
def d7_cluster_parents(spark, sf_dir):
    m = P.tree(spark, sf_dir).withColumns({"cluster": F.expr("if(ord <= 10, 0, 1 + (ord - 11) % 3)"), "file_no": F.lit(0)})
    return lineage.cluster_parents(m)


@query("SELECT DISTINCT folder_id, member_id FROM members", P.FOLDERS)
def j2_distinct_members(spark, sf_dir):
    m = P.folders(spark, sf_dir)[1]
    return annotate.distinct_members(m.unionByName(m))


@query("""SELECT id, name, parent_id, level FROM kept""", P.DEEP + """, kept AS (SELECT id, name, parent_id, 0 AS level FROM deep WHERE parent_id IS NULL UNION ALL SELECT d.id, d.name, d.parent_id, level + 1 FROM kept JOIN deep d ON d.parent_id = kept.id WHERE d.k % 5 <> 3)""", True)
def m10_load_folder_tree(spark, sf_dir):
    f = P.deep_folders(spark, sf_dir)[0]
    orphaned = f.withColumn("parent_id", F.when((F.col("k") % 5 == 3) & (F.col("k") >= 3), "nowhere").otherwise(F.col("parent_id")))
    return annotate.load_folder_tree(orphaned.drop("k"))


@query("""SELECT "S", ord, CASE WHEN is_array THEN concat_ws(' ', nullif(text, ''), CASE WHEN "S" % 3 = 2 THEN 'r' || ord END) ELSE text END AS search_text FROM con WHERE type IN ('user', 'assistant')""", P.CONTENTS)
def k1_searchable_text(spark, sf_dir):
    return search.searchable_text(P.contents(spark, sf_dir), _parts(spark, sf_dir)).select("S", "ord", "search_text")


@query("""SELECT "S", ord, false AS is_shared FROM msg WHERE "S" % 2 = 1 UNION ALL SELECT "S" + 1, ord, true FROM msg p WHERE "S" % 2 = 0 AND EXISTS (SELECT 1 FROM msg c WHERE c."S" = p."S" + 1) AND ("S" % 4 <> 0 OR ord <= 1 OR NOT EXISTS (SELECT 1 FROM msg a WHERE a."S" = p."S" AND a.ord = 1))""", P.MESSAGES)
def d8_with_shared_context(spark, sf_dir):
    """Odd sessions share with the one before: up to its second row, or, where the point is unknown, all of it."""
    m = P.messages(spark, sf_dir)
    own = m.where("S % 2 = 1")
    links = own.select("S", (F.col("S") - 1).alias("parent_S"), F.expr("if(S % 4 = 1, concat(S - 1, '-1'), 'gone')").alias("point")).distinct()
    return lineage.with_shared_context(own, m, links).select("S", "ord", "is_shared")


@query("""SELECT CAST("S" AS VARCHAR) AS id, "S", first_user_message, CAST(NULL AS VARCHAR) AS point FROM summary UNION ALL SELECT "S" || ':intra-1', "S", text, uuid FROM msg WHERE ord = 2""", _SUMMARY)
def g6_branch_rows(spark, sf_dir):
    branches = P.messages(spark, sf_dir).where("ord = 2").select("S", F.lit(1).alias("branch_no"), F.col("text").alias("first_user_message"), F.col("uuid").alias("point"), F.col("uuid").alias("leaf"))
    return lineage.branch_rows(branches, _summary(spark, sf_dir).select("S", "first_user_message")).select("id", "S", "first_user_message", "point")


_FACTS = _BRANCHES + """, found AS (SELECT l."S", row_number() OVER (PARTITION BY l."S" ORDER BY rank) - 1 AS no, l.start, common FROM longest l JOIN swaps w ON w."S" = l."S" AND w.start = l.start WHERE n >= 3),
 nodes AS (SELECT f."S", f.no, f.common, p.node, p.distance FROM found f JOIN path p ON p."S" = f."S" AND p.start = f.start),
 share AS (SELECT x."S", x.no, y.no AS other, count(*) AS n FROM nodes x JOIN nodes y ON x."S" = y."S" AND x.node = y.node AND x.no <> y.no GROUP BY 1, 2, 3, x.common, y.common HAVING count(*) > x.common AND count(*) > y.common),
 parent AS (SELECT "S", no, arg_max(other, n * 1000 - other) AS up FROM share GROUP BY 1, 2),
 held AS (SELECT "S", -1 AS up, node FROM main UNION ALL SELECT "S", no, node FROM nodes),
 way AS (SELECT n."S", n.no, u.up, n.node, n.distance, h.node IS NULL AS own, f.ts, f.by_user, f.text FROM nodes n LEFT JOIN parent u ON u."S" = n."S" AND u.no = n.no LEFT JOIN held h ON h."S" = n."S" AND h.up = coalesce(u.up, -1) AND h.node = n.node JOIN facts f ON f."S" = n."S" AND f.rn = n.node),
 branch AS (SELECT "S", no, up, CAST(arg_max(ts, distance) FILTER (own) AS VARCHAR) AS created_at, CAST(arg_min(ts, distance) FILTER (own) AS VARCHAR) AS updated_at, count(*) AS message_count, least(count(*) FILTER (by_user), count(*) FILTER (NOT by_user)) AS turn_count,
  coalesce(left(arg_max(text, distance) FILTER (own AND by_user), 200), '') AS first_user_message, CAST(coalesce(arg_min(node, distance) FILTER (NOT own), arg_max(node, distance)) AS VARCHAR) AS point, CAST(arg_min(node, distance) AS VARCHAR) AS leaf FROM way GROUP BY 1, 2, 3),
 session AS (SELECT "S", CAST(min(ts) AS VARCHAR) AS created_at, CAST(max(ts) AS VARCHAR) AS updated_at, count(*) AS message_count, least(count(*) FILTER (by_user), count(*) FILTER (NOT by_user)) AS turn_count, left(coalesce(arg_min(text, rn) FILTER (by_user), ''), 200) AS first_user_message FROM facts GROUP BY 1),
 kids AS (SELECT "S", coalesce(up, -1) AS no, string_agg("S" || ':intra-' || no, ',' ORDER BY no) AS children FROM branch GROUP BY 1, 2)"""


@query("""SELECT b."S" || ':intra-' || b.no AS id, created_at, updated_at, message_count, turn_count, first_user_message, point, leaf, b."S" || coalesce(':intra-' || up, '') AS parent_id, coalesce(children, '') AS children FROM branch b LEFT JOIN kids k ON k."S" = b."S" AND k.no = b.no
 UNION ALL SELECT CAST(s."S" AS VARCHAR), created_at, updated_at, message_count, turn_count, first_user_message, NULL, NULL, NULL, coalesce(children, '') FROM session s LEFT JOIN kids k ON k."S" = s."S" AND k.no = -1""", _FACTS, True)
def g6_detected_branch_rows(spark, sf_dir):
    _, rows = _branch_rows(P.tree(spark, sf_dir))
    return rows.select("id", "created_at", "updated_at", "message_count", "turn_count", "first_user_message", "point", "leaf", "parent_id", F.array_join("child_ids", ",").alias("children"))


def _branch_rows(m):
    """Detected branches of ``m``, and the rows of its sessions and branches."""
    kept = {"is_sidechain": F.lit(False), **{c: F.lit(None).cast("string") for c in ("cwd", "version", "slug", "permission_mode")}}
    whole = summary.session_summary(m.withColumns({c: v for c, v in kept.items() if c not in m.columns}))
    forest = lineage.plant(m, forks_only=True)
    found = lineage.detect_branches(m, forest=forest)
    rows = lineage.branch_rows(lineage.branch_facts(found, forest), whole)
    forest.drop()
    return found, rows


@query("""SELECT d.id, md5('# ' || left(first_user_message, 60) || chr(10) || chr(10) || '> ' || strftime(CAST(created_at AS TIMESTAMP), '%-m/%-d %H:%M') || ' | ' || turn_count || ' turns' || chr(10) || chr(10) || body) AS digest
 FROM (SELECT "S" || ':intra-' || no AS id, created_at, turn_count, first_user_message FROM branch UNION ALL SELECT CAST("S" AS VARCHAR), created_at, turn_count, first_user_message FROM session) h JOIN
 (SELECT id, string_agg(CASE WHEN by_user THEN '**User** [' ELSE '**Assistant** [' END || strftime(ts, '%-m/%-d %H:%M') || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rn) AS body
  FROM (SELECT CAST("S" AS VARCHAR) AS id, rn, ts, by_user, text FROM facts UNION ALL SELECT n."S" || ':intra-' || n.no, f.rn, f.ts, f.by_user, f.text FROM nodes n JOIN facts f ON f."S" = n."S" AND f.rn = n.node) GROUP BY 1) d ON d.id = h.id""", _FACTS, True)
def a4_branch_transcripts(spark, sf_dir):
    m = P.tree(spark, sf_dir)
    found, rows = _branch_rows(m)
    return export.branch_transcripts(m, found, rows).select("id", F.md5("markdown").alias("digest"))


_CONFIG = """inv AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN '/a/conf.md' WHEN 1 THEN '/a/w/own.md' WHEN 2 THEN '/b/conf.md' ELSE CASE WHEN page_id % 4 = 1 THEN '/b/w/' ELSE '/a/w/' END || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '/conf.md' ELSE '/own.md' END END AS path FROM pages),
 dirs AS (SELECT DISTINCT CASE WHEN "S" % 2 = 0 THEN '/a' ELSE '/b' END || cwd AS cwd FROM msg),
 cand AS (SELECT cwd || '/conf.md' AS path, 0 AS level FROM dirs UNION SELECT cwd || '/own.md', 0 FROM dirs UNION SELECT '/b/w/conf.md', 1 UNION SELECT '/b/conf.md', 2 UNION SELECT '/a/w/2/conf.md', -1 UNION SELECT '/a/w/2/own.md', -1)"""


@query("SELECT path, min(level) AS level FROM cand WHERE path IN (SELECT path FROM inv) GROUP BY 1", f"{P.MESSAGES}, {_CONFIG}")
def d10_config_file_candidates(spark, sf_dir):
    """Half of the directories lie under home (/a/w), where the walk ends, half elsewhere; one is a project's root."""
    path = "case page_id % 5 when 0 then '/a/conf.md' when 1 then '/a/w/own.md' when 2 then '/b/conf.md' else concat(if(page_id % 4 = 1, '/b/w/', '/a/w/'), page_id % 3, if(page_id % 2 = 0, '/conf.md', '/own.md')) end"
    inventory = P.read(spark, sf_dir, "pages").select(F.expr(path).alias("path"))
    cwds = P.messages(spark, sf_dir).select(F.expr("concat(if(S % 2 = 0, '/a', '/b'), cwd)").alias("cwd")).distinct()
    return summary.config_file_candidates(cwds, inventory, ("conf.md",), ("own.md",), home="/a/w", project="/logs/-a-w-2", project_names=("notes.md",))


@query("""SELECT session_id, id, length(text) AS n_chars FROM (SELECT 's' || doc_id AS session_id, 'h' || doc_id AS id, 'kept' AS text FROM labels WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0
 UNION ALL SELECT 's' || doc_id, 'n' || doc_id, left(text, 2000) FROM documents WHERE doc_id % 7 = 1)""")
def m7_apply_highlights(spark, sf_dir):
    row = lambda df, mark, text: df.select(F.concat(F.lit("s"), "doc_id").alias("session_id"), F.concat(F.lit(mark), "doc_id").alias("id"), text.alias("text"))
    labels = P.read(spark, sf_dir, "labels")
    added = row(P.read(spark, sf_dir, "documents").where("doc_id % 7 = 1"), "n", F.col("text"))
    out = annotate.apply_highlights(row(labels.where("doc_id % 2 = 0"), "h", F.lit("kept")), added, row(labels.where("doc_id % 3 = 0"), "h", F.lit("")))
    return out.select("session_id", "id", F.length("text").cast("long").alias("n_chars"))


def _library(spark, sf_dir):
    title = F.when(F.col("quality") == 1, F.concat(F.lit("t"), "doc_id"))
    meta = P.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), title.alias("custom_title"), F.expr("if(toxic = 1, 'n', '')").alias("notes"))
    d = P.read(spark, sf_dir, "documents")
    branches = d.where("doc_id % 6 = 0").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("custom_title"), F.lit("b").alias("notes"), F.lit(0).cast("long").alias("n_highlights"))
    folders, members = P.deep_folders(spark, sf_dir)
    placed = P.read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.expr("o_orderkey % 50")).alias("folder_id"), F.concat(F.lit("b"), "o_orderkey").alias("member_id"))
    return annotate.flatten_library(folders, _order(folders), members, meta, d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("session_id")), placed, branches)


@query("""SELECT * FROM (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 't' || l.doc_id END AS custom_title, CASE WHEN toxic = 1 THEN 'n' ELSE '' END AS notes, coalesce(h.n, 0) AS n_highlights
 FROM labels l LEFT JOIN (SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 5 = 0 GROUP BY 1) h ON l.doc_id = h.doc_id WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 6 = 0)) WHERE custom_title IS NOT NULL OR notes <> '' OR n_highlights > 0
 UNION ALL SELECT doc_id, NULL, 'b', 0 FROM documents WHERE doc_id % 6 = 0""")
def m11_flatten_library(spark, sf_dir):
    return _library(spark, sf_dir)["meta"]


@query("SELECT c.descendant AS id, string_agg(CAST(spot AS VARCHAR), '.' ORDER BY depth DESC) AS way FROM closure c JOIN base b ON b.id = c.ancestor GROUP BY 1", _PLACED, True)
def m11_library_folders(spark, sf_dir):
    return _library(spark, sf_dir)["folders"].select("id", F.concat_ws(".", F.col("way").cast("array<string>")).alias("way"))


@query("""SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS folder_id, 'o' || o_orderkey AS member_id FROM orders UNION ALL SELECT id, 'b' || o_orderkey FROM orders JOIN deep ON id = 'c' || (o_orderkey % 50))""", P.DEEP, True)
def m11_library_members(spark, sf_dir):
    return _library(spark, sf_dir)["members"]


@query("""SELECT b.id, b.parent_id, row_number() OVER (PARTITION BY b.parent_id ORDER BY CASE WHEN b.k % 30 = 15 THEN coalesce(t.spot - 0.5, 1e9) ELSE b.spot END, b.id) AS place FROM base b LEFT JOIN base t ON b.k % 30 = 15 AND t.k = b.k + 1""", _PLACED, True)
def h5_reorder_folders(spark, sf_dir):
    f = P.deep_folders(spark, sf_dir)[0]
    moves = f.where("k % 30 = 15").select("id", F.concat(F.lit("c"), F.col("k") + 1).alias("target"), F.lit("before").alias("side"))
    return annotate.reorder_folders(f, _order(f), moves)


@query("""SELECT p."S", p.ord, 0 AS i, path, coalesce(f.at, -1) AS image_ord, false AS is_pasted FROM p LEFT JOIN f ON p."S" = f."S" AND p.ts = f.ts
 UNION ALL SELECT "S", ord, i, NULL, ord, true FROM v, range(2) r(i) WHERE i <= v.k % 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p."S" = v."S" AND p.ts = v.ts)""", P.CALLS + """, u AS (SELECT *, strftime(time, '%Y-%m-%d') AS ts FROM calls WHERE message_type = 'assistant'),
 p AS (SELECT * FROM u WHERE event_type = 'click'), v AS (SELECT * FROM u WHERE event_type = 'view'), f AS (SELECT "S", ts, min(ord) AS at FROM v GROUP BY 1, 2)""")
def d11_image_gallery(spark, sf_dir):
    """Clicks show a path, views one image or two."""
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("[Image: source: "), "path", F.lit("]"))).otherwise("")
    kind = F.when(F.col("message_type") == "assistant", "user").otherwise("other")
    m = P.calls(spark, sf_dir).select("S", "ord", kind.alias("type"), F.date_format("time", "yyyy-MM-dd").alias("ts"), text.alias("text"), "k", "event_type")
    images = m.where("event_type = 'view'").select("S", "ord", F.explode(F.sequence(F.lit(0), (F.col("k") % 2).cast("int"))).alias("i"))
    return annotate.image_gallery(m, images).withColumn("image_ord", F.coalesce("image_ord", F.lit(-1)))
