"""Transcripts, backups and what tells whether they are current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators.lineage import document_messages
from talkweave.operators.messages import field
from talkweave.operators.summary import top_tools


def joined_lines(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], line: str = "line") -> DataFrame:
    """(by, markdown): lines put together in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[line]), "\n").alias("markdown"))


def tool_lines(calls: DataFrame) -> DataFrame:
    return calls.withColumn("line", T.tool_line("name", lambda f: field(f, "input")))


def transcript_compact(m: DataFrame, header: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(S, markdown). m: S, ord, type, ts, text. header: S, title, created_at, turn_count, tools (or null). calls: S, ord, pos, line.

    A block for each user row with text, system-injected ones included, and each
    assistant row with text or tools, whose lines come first. Times are UTC.
    """
    stamp = F.coalesce(T.short_time("ts"), F.lit(""))
    text = T.strip("text")
    talk = m.where("type in ('user', 'assistant')").select("S", "ord", "type", text.alias("text"), stamp.alias("stamp"))
    if calls is not None:
        talk = talk.join(calls.groupBy("S", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("tools")), ["S", "ord"], "left")
    else:
        talk = talk.withColumn("tools", F.lit(None).cast("array<string>"))
    tools = F.when(F.col("type") == "assistant", F.coalesce("tools", F.expr("cast(array() as array<string>)"))).otherwise(F.expr("cast(array() as array<string>)"))
    shown = talk.withColumn("tools", tools).where("text <> '' or size(tools) > 0")
    own = F.when(F.col("text") != "", F.array("text")).otherwise(F.expr("cast(array() as array<string>)"))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("**"), F.initcap("type"), F.lit("** ["), F.col("stamp"), F.lit("]"))), F.col("tools"), own, F.array(F.lit(""))), "\n")
    tool_part = F.coalesce(F.concat(F.lit(" | Tools: "), T.present("tools")), F.lit(""))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n> "), T.short_time("created_at"), F.lit(" | "), F.col("turn_count").cast("string"), F.lit(" turns"), tool_part, F.lit("\n"))
    rows = shown.select("S", F.col("ord").cast("long").alias("ord"), block.alias("line")).unionByName(header.select("S", F.lit(-1).cast("long").alias("ord"), head.alias("line")))
    return joined_lines(rows, ("S",), ("ord",))


def _fence(*inner: Column, kind: str = "") -> Column:
    return F.concat_ws("\n", F.lit(f"```{kind}"), *inner, F.lit("```"))


def tool_markdown(name: Column, arg, result: Column, input_json: Column) -> Column:
    """A tool call by its kind, with what is long cut."""
    given = lambda f: F.coalesce(arg(f), F.lit("")) != ""
    quoted = F.concat(F.lit("> "), name, F.lit(" `"), F.coalesce(arg("file_path"), arg("pattern")), F.lit("`"))
    short = lambda x, n: F.left(T.present(x), F.lit(n))
    marked = lambda mark, x: F.array_join(F.transform(F.split(x, "\n"), lambda y: F.concat(F.lit(mark), y)), "\n")
    diff = F.when(given("old_string"), _fence(marked("- ", arg("old_string")), marked("+ ", F.coalesce(arg("new_string"), F.lit(""))), kind="diff"))
    return (
        F.when((name == "Bash") & given("command"), _fence(F.concat(F.lit("$ "), arg("command")), short(result, 2000), kind="bash"))
        .when((name == "Read") & given("file_path"), quoted)
        .when((name == "Write") & given("file_path"), F.concat_ws("\n", quoted, F.when(given("content"), _fence(F.left(arg("content"), F.lit(1000))))))
        .when((name == "Edit") & given("file_path"), F.concat_ws("\n", quoted, diff))
        .when(name.isin("Grep", "Glob") & given("pattern"), F.concat_ws("\n", F.concat(F.lit("> "), name, F.lit(" `"), arg("pattern"), F.lit("`")), F.when(F.coalesce(result, F.lit("")) != "", _fence(short(result, 1000)))))
        .when(name == "Agent", F.concat_ws("\n", F.concat(F.lit("> Agent: "), F.coalesce(short(arg("prompt"), 100), F.lit("subagent"))), F.when(F.coalesce(result, F.lit("")) != "", _fence(short(result, 2000)))))
        .otherwise(F.concat_ws("\n", F.concat(F.lit("> "), name), _fence(F.left(input_json, F.lit(500)), kind="json")))
    )


def transcript_full(turned: DataFrame, header: DataFrame, labels: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(S, markdown) of turns: a heading and quote for each user's text, a block for a compaction's summary, assistants' texts and tools, a rule after each turn.

    turned: rows of ``turns`` with ts. header: S, title, created_at, turn_count and, if there is
    one, tools. labels: S, section_no, kind. calls: S, ord, pos, line of ``tool_markdown``.
    Headings in texts become bold.
    """
    place = lambda ord_, pos: [F.col("section_no").cast("long").alias("section_no"), ord_.cast("long").alias("ord"), pos.cast("long").alias("pos")]
    text = T.strip("turn_text")
    first = F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(50))
    heading = F.concat(F.lit("##### "), first, F.when(F.length(text) > F.length(first), "...").otherwise(""), F.lit("\n"))
    stamp = F.concat(F.lit("*"), T.short_time("ts"), F.lit("*\n"))
    quote = F.array_join(F.transform(F.split(T.bold_headings(text), "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    rest = T.strip(F.substring(text, F.lit(len(T.SUMMARY_PREFIX) + 1), F.length(text)))
    summary = F.concat_ws("\n", F.lit("*Compaction summary*\n"), F.lit("```"), F.left(rest, F.lit(3000)), F.lit("```"), F.lit(""))
    user = F.when(text.startswith(T.SUMMARY_PREFIX), summary).otherwise(F.concat_ws("\n", heading, stamp, quote, F.lit("")))
    asked = turned.where("starts_turn").select("S", *place(F.col("ord"), F.lit(0)), user.alias("line"))
    own = T.strip("text")
    said = turned.where((F.col("type") == "assistant") & (own != "")).select("S", *place(F.col("ord"), F.lit(0)), F.concat(T.bold_headings(own), F.lit("\n")).alias("line"))
    ends = turned.groupBy("S", "section_no", "turn_no").agg(F.max("ord").alias("ord")).select("S", *place(F.col("ord"), F.lit(2**31)), F.lit("---\n").alias("line"))
    rows = asked.unionByName(said).unionByName(ends)
    if calls is not None:
        at = turned.where("type = 'assistant'").select("S", "ord", "section_no")
        rows = rows.unionByName(calls.join(at, ["S", "ord"]).select("S", *place(F.col("ord"), F.col("pos") + 1), F.concat("line", F.lit("\n")).alias("line")))
    several = labels.groupBy("S").agg(F.count("*").alias("n"))
    heads = labels.join(several, "S").where("kind <> 'current' or n > 1").select("S", *place(F.lit(-1), F.lit(0)), F.concat(F.lit("## "), "kind", F.lit("\n")).alias("line"))
    tools = T.present("tools") if "tools" in header.columns else F.lit(None).cast("string")
    counted = F.concat(F.lit("> "), T.short_time("created_at"), F.lit(" | "), F.col("turn_count").cast("string"), F.lit(" turns"))
    top = F.concat_ws("\n", F.concat(F.lit("# "), "title", F.lit("\n")), counted, F.concat(F.lit("> Tools: "), tools), F.lit(""))
    top = header.withColumn("section_no", F.lit(-1)).select("S", *place(F.lit(-1), F.lit(0)), top.alias("line"))
    return joined_lines(rows.unionByName(heads).unionByName(top), ("S",), ("section_no", "ord", "pos"))


def tool_summary(usage: DataFrame, k: int = 6) -> DataFrame:
    """(S, tools): the most used tools with their counts, as transcripts name them."""
    top = top_tools(usage, k).select("S", "rank", F.concat("tool", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("x"))
    return top.groupBy("S").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "x"))), lambda y: y["x"]), ", ").alias("tools"))


def export_selection(turned: DataFrame, picks: DataFrame) -> DataFrame:
    """(S, section_no, turn_no, ord, type, text) of picked turns: their question, their answers, or both; picks: S, section_no, turn_no, question, answer."""
    j = turned.join(picks, ["S", "section_no", "turn_no"])
    return j.where((F.col("question") & (F.col("type") == "user")) | (F.col("answer") & (F.col("type") == "assistant"))).select("S", "section_no", "turn_no", "ord", "type", "text")


def export_filename(created: Column, first_message: Column, id: Column) -> Column:
    """N4."""
    title = F.coalesce(T.present(F.left(first_message, F.lit(30))), id)
    safe = F.left(F.regexp_replace(title, "[^a-zA-Z0-9一-鿿_-]", "_"), F.lit(30))
    return F.concat(F.lit("transcript-"), F.date_format(F.to_timestamp(created), "yyyy-MM-dd"), F.lit("-"), safe)


def branch_transcripts(m: DataFrame, branches: DataFrame, rows: DataFrame) -> DataFrame:
    """A4: (id, markdown) of each session and each of its branches (N1); rows: those of ``branch_rows``, which give titles, times and turns."""
    head = rows.select(F.col("id").alias("S"), F.left("first_user_message", F.lit(60)).alias("title"), "created_at", "turn_count", F.lit(None).cast("string").alias("tools"))
    documents = document_messages(m, branches).withColumn("S", F.col("id")).drop("id")
    return transcript_compact(documents, head).withColumnRenamed("S", "id")


def write_transcripts(documents: DataFrame, path: str) -> None:
    """A4: one row (id, markdown) for each session or branch."""
    documents.select("id", "markdown").write.mode("overwrite").parquet(path)


def write_backup(raw: DataFrame, path: str, replace_all: bool = True) -> None:
    """A5: raw lines (S, file_no, ord, value) as text in a folder for each session, in order; nothing if there are none.

    Sessions are dealt by hash over the session's shuffle partitions. Without ``replace_all`` only the folders of the sessions that come here are replaced.
    """
    if raw.isEmpty():
        return
    rows = raw.repartition("S").sortWithinPartitions("S", "file_no", "ord").select("S", "value")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace_all else "dynamic").partitionBy("S").text(path)


def stale_exports(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids whose newest source (id, mtime) is later than their target, or that have none. Sources without a time are missing files."""
    newest = sources.where("mtime is not null").groupBy("id").agg(F.max("mtime").alias("newest"))
    return newest.join(targets.select("id", F.col("mtime").alias("written")), "id", "left").where("written is null or newest > written").select("id")


def upsert_session_registry(existing: DataFrame, summaries: DataFrame) -> DataFrame:
    """(id, title, updated_at, sources): new rows come in; a title changes if given; time and sources change if the time differs."""
    e, n = existing.alias("e"), summaries.alias("n")
    j = e.join(n, F.col("e.id") == F.col("n.id"), "full_outer")
    moved = F.col("e.id").isNull() | (F.col("n.id").isNotNull() & ~F.col("e.updated_at").eqNullSafe(F.col("n.updated_at")))
    return j.select(
        F.coalesce("e.id", "n.id").alias("id"), F.coalesce(T.present("n.title"), "e.title").alias("title"),
        *(F.when(moved, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in ("updated_at", "sources")),
    )
