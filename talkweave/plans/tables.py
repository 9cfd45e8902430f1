"""The shared tables as messages, tool calls, trees, usage, documents, paths, file ranges and folders.

Each projection has the same text in Spark and in the SQL it is compared with, but
for what the two dialects write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: a session each; boundaries and sidechains by arithmetic."""
    c = read(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(
        F.col("conv_id").alias("S"), F.col("turn").alias("ord"), F.col("role").alias("type"), F.coalesce("text", F.lit("")).alias("text"),
        F.expr("(conv_id + turn) % 5 = 0").alias("is_boundary"), F.expr("if((conv_id + turn) % 5 = 0, 'compact_boundary', null)").alias("subtype"),
        F.expr("(conv_id * 7 + turn) % 11 = 0").alias("is_sidechain"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.expr("concat('/w/', conv_id % 4 + turn % 2)").alias("cwd"), F.expr("concat('1.', turn)").alias("version"),
        F.expr("if(turn % 3 = 1, concat('slug-', turn), null)").alias("slug"), F.expr("if(turn % 2 = 0, 'default', 'plan')").alias("permission_mode"),
        F.concat_ws("-", "conv_id", "turn").alias("uuid"),
    )


MESSAGES = """msg AS (SELECT conv_id AS "S", turn AS ord, role AS type, coalesce(text, '') AS text, (conv_id + turn) % 5 = 0 AS is_boundary,
 CASE WHEN (conv_id + turn) % 5 = 0 THEN 'compact_boundary' END AS subtype, (conv_id * 7 + turn) % 11 = 0 AS is_sidechain,
 strftime(make_timestamp((1767225600 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts,
 '/w/' || (conv_id % 4 + turn % 2) AS cwd, '1.' || turn AS version, CASE WHEN turn % 3 = 1 THEN 'slug-' || turn END AS slug,
 CASE WHEN turn % 2 = 0 THEN 'default' ELSE 'plan' END AS permission_mode, conv_id || '-' || turn AS uuid FROM conversations)"""

_MARKED = (
    "<task-notification>x", "Base directory for this skill: /s", "<command-name>/login</command-name>\n<local-command-stdout> ok </local-command-stdout>",
    " <system-reminder>a\nb</system-reminder>\n", "Tool loaded.", "[Image: source: /img/a.png] [Image: source: /img/b c.png]", "<local-command-caveat>careful</local-command-caveat> note",
)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages whose texts carry a marker of the log format, by turn and session."""
    case = F.col("text")
    for k, t in enumerate(_MARKED):
        case = F.when(F.expr("(S + ord) % 9") == k, F.lit(t)).otherwise(case)
    long = F.when(F.expr("(S + ord) % 9 = 7"), F.concat(F.lit("<system-reminder>r</system-reminder> "), "text", F.lit(" [Image: source: /img/"), "S", F.lit(".png]"))).otherwise(case)
    return messages(spark, sf_dir).withColumns({"type": F.expr("if((S + ord) % 9 < 8, 'user', type)"), "text": long})


MARKED = MESSAGES + """, marked AS (SELECT * REPLACE (CASE WHEN ("S" + ord) % 9 < 8 THEN 'user' ELSE type END AS type, CASE ("S" + ord) % 9 """ + " ".join(
    "WHEN {} THEN '{}'".format(k, t.replace("\n", "' || chr(10) || '")) for k, t in enumerate(_MARKED)
) + """ WHEN 7 THEN '<system-reminder>r</system-reminder> ' || text || ' [Image: source: /img/' || "S" || '.png]' ELSE text END AS text) FROM msg)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls of a user's session, some in users' rows."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    tool = F.expr("case event_type when 'click' then 'Read' when 'view' then 'Edit' when 'purchase' then 'Write' else 'Bash' end")
    return e.select(F.col("user_id").alias("S"), F.col("event_id").alias("ord"), F.col("ts").alias("time"), "event_type", tool.alias("name"), k.alias("k"), F.concat(F.lit("/src/"), k.cast("string")).alias("path"), "value", F.expr("if(event_id % 11 = 0, 'user', 'assistant')").alias("message_type"))


CALLS = """calls AS (SELECT user_id AS "S", event_id AS ord, ts AS time, event_type, CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Edit' WHEN 'purchase' THEN 'Write' ELSE 'Bash' END AS name,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '/src/' || json_extract_string(props, '$.k') AS path, value, CASE WHEN event_id % 11 = 0 THEN 'user' ELSE 'assistant' END AS message_type FROM events)"""


def acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: each names an image path and calls a tool; users' ones do where the message is a user's or the tool is Bash."""
    c = calls(spark, sf_dir)
    said = "to_json(named_struct('type', 'text', 'text', concat('see [Image: source: ', path, ' ]')))"
    used = "to_json(named_struct('type', 'tool_use', 'id', string(ord), 'name', name, 'input', named_struct('file_path', path)))"
    kind = F.expr("if(message_type = 'user' or name = 'Bash', 'user', 'assistant')")
    return c.select("S", F.lit("f").alias("file"), "ord", kind.alias("type"), F.col("time").cast("string").alias("ts"), F.expr(f"parse_json(concat('[', {said}, ',', {used}, ']'))").alias("content"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of a user as a forest: a chain of ten, a fork of three, then chains three apart."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    parent = F.expr("case when rn = 1 then null when rn <= 10 then rn - 1 when rn <= 13 then 10 else rn - 3 end")
    user = F.col("event_type").isin("click", "view")
    return e.select(
        F.col("user_id").cast("string").alias("S"), F.col("rn").alias("ord"), F.col("rn").cast("string").alias("uuid"), parent.cast("string").alias("parent"), F.lit(None).cast("string").alias("logical_parent"),
        F.lit(None).cast("string").alias("subtype"), F.when(user, "user").otherwise("assistant").alias("type"), F.col("ts").cast("string").alias("ts"), F.concat("event_type", "props").alias("text"), user.alias("is_real_user"),
    )


TREE = """tree AS (SELECT *, CASE WHEN rn = 1 THEN NULL WHEN rn <= 10 THEN rn - 1 WHEN rn <= 13 THEN 10 ELSE rn - 3 END AS parent FROM
 (SELECT user_id AS "S", event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
 leaf AS (SELECT "S", rn FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c."S" = t."S" AND c.parent = t.rn)),
 path AS (SELECT "S", rn AS start, rn AS node, 0 AS distance FROM leaf UNION ALL SELECT p."S", p.start, t.parent, p.distance + 1 FROM path p JOIN tree t ON t."S" = p."S" AND t.rn = p.node WHERE t.parent IS NOT NULL)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    d = lambda c, by: F.round(F.col(c) * by).cast("long")
    kind = F.expr("if(l_linenumber % 5 = 4, 'user', 'assistant')").alias("type")
    return li.select(F.col("l_orderkey").alias("S"), F.col("l_linenumber").alias("turn_no"), kind, d("l_quantity", 1).alias("input"), d("l_extendedprice", 100).alias("output"), d("l_discount", 100).alias("cache_creation"), d("l_tax", 100).alias("cache_read"))


USAGE = """usage AS (SELECT l_orderkey AS "S", l_linenumber AS turn_no, CASE WHEN l_linenumber % 5 = 4 THEN 'user' ELSE 'assistant' END AS type, CAST(round(l_quantity) AS BIGINT) AS input, CAST(round(l_extendedprice * 100) AS BIGINT) AS output, CAST(round(l_discount * 100) AS BIGINT) AS cache_creation, CAST(round(l_tax * 100) AS BIGINT) AS cache_read FROM lineitem)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("S"), F.col("o_orderkey").alias("file"), F.col("o_orderdate").cast("timestamp").alias("start"), F.expr("cast(o_orderdate as timestamp) + make_dt_interval(int(o_orderkey % 30))").alias("end"))


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents whose lines are headings, one in code."""
    t = F.concat(F.lit("# Top\n```\n# code\n```\n# "), F.replace("text", F.lit("\n"), F.lit("\n## ")), F.lit("\n## Top"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.alias("text"))


DOCS = """docs AS (SELECT doc_id AS id, '# Top' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '## ') || chr(10) || '## Top' AS text FROM documents),
 raw AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM docs),
 fenced AS (SELECT *, starts_with(line, '```') AS fence, sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY id ORDER BY n) % 2 = 1 OR starts_with(line, '```') AS in_code FROM raw),
 heads AS (SELECT id, n, length(regexp_extract(line, '^(#{1,6})', 1)) AS level, regexp_replace(regexp_replace(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1), '\\*\\*|`', '', 'g'), '^\\s+|\\s+$', '', 'g') AS title FROM fenced WHERE NOT in_code AND regexp_matches(line, '^#{1,6}\\s+.+$')),
 slugged AS (SELECT *, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9一-鿿_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 60), ''), 'heading') AS base FROM heads),
 toc AS (SELECT id, n, level, title, CASE WHEN row_number() OVER (PARTITION BY id, base ORDER BY n) > 1 THEN base || '-' || (row_number() OVER (PARTITION BY id, base ORDER BY n) - 1) ELSE base END AS slug FROM slugged)"""


def folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions and nations as folders, customers as members of their nation."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    m = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("folder_id"), F.concat(F.lit("c"), "c_custkey").alias("member_id"))
    return r.unionByName(n), m


FOLDERS = """folders AS (SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation),
 members AS (SELECT 'n' || c_nationkey AS folder_id, 'c' || c_custkey AS member_id FROM customer)"""


def deep_folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as folders, three under each, and orders as members: as deep as the logarithm of the customers."""
    id_ = lambda x: F.concat(F.lit("c"), x)
    c = read(spark, sf_dir, "customer").select(id_("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") >= 3, id_(F.expr("c_custkey div 3"))).alias("parent_id"), F.col("c_custkey").alias("k"))
    o = read(spark, sf_dir, "orders").select(id_("o_custkey").alias("folder_id"), F.concat(F.lit("o"), "o_orderkey").alias("member_id"))
    return c, o


DEEP = """deep AS (SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey >= 3 THEN 'c' || (c_custkey // 3) END AS parent_id, c_custkey AS k FROM customer),
 closure AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM deep UNION ALL SELECT f.parent_id, c.descendant, c.depth + 1 FROM closure c JOIN deep f ON f.id = c.ancestor JOIN deep p ON p.id = f.parent_id)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with their content: a string in every fourth turn, else a text, a tool call, a tool result and an image."""
    image = "named_struct('type', 'image', 'source', named_struct('type', 'base64', 'media_type', 'image/png', 'data', repeat('A', {})))"
    name = "case ord % 3 when 0 then 'Edit' when 1 then 'Skill' else 'Read' end"
    args = "named_struct('old_string', concat('old', ord, '\\nmore'), 'new_string', concat('new', S), 'skill', if(S % 2 = 0, null, concat('s', ord)), 'args', concat('a', ord))"
    nested = f"concat('[', to_json(named_struct('type', 'text', 'text', concat('p', S))), ',\"q\",', to_json({image.format(2)}), ']')"
    said = f"case S % 3 when 0 then {nested} when 1 then '\"\"' else concat('\"r', ord, '\"') end"
    parts = (
        "to_json(named_struct('type', 'text', 'text', text))", f"to_json(named_struct('type', 'tool_use', 'id', uuid, 'name', {name}, 'input', {args}))",
        f"concat('{{\"type\":\"tool_result\",\"tool_use_id\":\"', uuid, '\",\"content\":', {said}, '}}')", f"to_json({image.format('int(ord) + 1')})",
    )
    content = f"parse_json(if(ord % 4 = 3, get_json_object(to_json(named_struct('t', array(text))), '$.t[*]'), concat('[', {', \',\', '.join(parts)}, ']')))"
    return messages(spark, sf_dir).withColumns({"content": F.expr(content), "file": F.concat(F.lit("/p/"), F.col("S").cast("string"), F.expr("if(ord % 5 = 0, '/subagents/a', '/main')"))})


CONTENTS = MESSAGES + """, con AS (SELECT *, ord % 4 <> 3 AS is_array, CASE ord % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Skill' ELSE 'Read' END AS tool, '/p/' || "S" || CASE WHEN ord % 5 = 0 THEN '/subagents/a' ELSE '/main' END AS file FROM msg)"""
