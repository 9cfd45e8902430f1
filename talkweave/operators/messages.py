"""Flattening and classification of messages. Messages are keyed by session S and order ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import text as T

KEY = ["S", "file", "ord"]


def valid_messages(m: DataFrame) -> DataFrame:
    """C1."""
    return m.where(F.col("type").isin("user", "assistant", "system"))


def main_chain(m: DataFrame) -> DataFrame:
    """C5."""
    return m.where(~F.coalesce("is_sidechain", F.lit(False)))


def explode_parts(m: DataFrame) -> DataFrame:
    """B2: (S, file, ord, type of the message, ts, pos, part) of array content; string content has no parts."""
    parts = F.try_variant_get("content", "$", "array<variant>")
    return m.where(parts.isNotNull()).select(*KEY, F.col("type").alias("message_type"), "ts", F.posexplode(parts).alias("pos", "part"))


def field(path: str, column: str = "part", kind: str = "string") -> Column:
    return F.try_variant_get(column, f"$.{path}", kind)


def content_text(content: str = "content", separator: str = "\n") -> Column:
    """String content as it is; of an array, the non-empty text parts joined."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    own = lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))
    joined = F.array_join(F.filter(F.transform(parts, own), lambda t: t.isNotNull() & (t != "")), separator)
    return F.coalesce(F.when(parts.isNotNull(), joined).otherwise(F.try_variant_get(content, "$", "string")), F.lit(""))


def extract_text(m: DataFrame) -> DataFrame:
    return m.withColumn("text", content_text())


def tool_calls(parts: DataFrame) -> DataFrame:
    """(S, file, ord, pos, ts, message_type, id, name, input)."""
    return parts.where((field("type") == "tool_use") & (field("name") != "")).select(
        *KEY, "pos", "ts", "message_type", field("id").alias("id"), field("name").alias("name"), F.coalesce(field("input", kind="variant"), F.parse_json(F.lit("{}"))).alias("input")
    )


def tool_results(parts: DataFrame) -> DataFrame:
    """(S, file, ord, pos, id, result) of non-empty results on user rows; arrays are text parts and bare strings, joined."""
    nested = F.try_variant_get("part", "$.content", "array<variant>")
    bare = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))
    text = lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))
    items = F.filter(F.transform(nested, lambda p: F.coalesce(text(p), bare(p))), lambda t: t.isNotNull() & (t != ""))
    result = F.when(nested.isNotNull(), F.array_join(items, "\n")).otherwise(field("content"))
    return parts.where((F.col("message_type") == "user") & (field("type") == "tool_result")).select(
        *KEY, "pos", field("tool_use_id").alias("id"), result.alias("result")
    ).where("result <> ''")


def inline_images(parts: DataFrame) -> DataFrame:
    """(S, file, ord, pos, media_type, n_chars): base64 images, also one level down in tool results."""
    inner = parts.where(field("type") == "tool_result").select(*KEY, "ts", "pos", F.explode(F.try_variant_get("part", "$.content", "array<variant>")).alias("part"))
    found = parts.select(*KEY, "ts", "pos", "part").unionByName(inner)
    return found.where((field("type") == "image") & (field("source.type") == "base64") & (field("source.data") != "") & (field("source.media_type") != "")).select(
        *KEY, "ts", "pos", field("source.media_type").alias("media_type"), F.length(field("source.data")).alias("n_chars")
    )


def pasted_image_count(parts: DataFrame) -> DataFrame:
    """Top-level base64 images on user rows."""
    return parts.where((F.col("message_type") == "user") & (field("type") == "image") & (field("source.type") == "base64")).groupBy("S").agg(F.count("*").alias("n_images"))


def token_usage(m: DataFrame) -> DataFrame:
    """The counters of rows that have any."""
    return m.where("usage is not null").select(*KEY, "type", "usage.*")


def skill_invocations(calls: DataFrame) -> DataFrame:
    """Of assistants' calls."""
    return calls.where("name = 'Skill' and message_type = 'assistant'").select(
        *KEY, "pos", F.coalesce(T.present(field("skill", "input")), F.lit("unknown")).alias("skill"), "ts", field("args", "input").alias("args")
    )


def image_path_refs(m: DataFrame) -> DataFrame:
    """B9, viewer: (S, ord, pos, path) of user rows' texts."""
    return m.where("type = 'user'").select("S", "ord", F.posexplode(T.image_paths("text")).alias("pos", "path"))


def part_image_path_refs(parts: DataFrame) -> DataFrame:
    """B9, summary: (S, ord, pos, i, path) of the parts of user rows that have a text; string content has none."""
    return parts.where("message_type = 'user'").select("S", "ord", "pos", F.posexplode(T.image_paths(field("text"))).alias("i", "path"))


def is_real_user() -> Column:
    """C3 over content."""
    parts = F.try_variant_get("content", "$", "array<variant>")
    kind = lambda p: F.try_variant_get(p, "$.type", "string")
    real = lambda p: (kind(p) == "text") & (F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")) != "") & ~T.is_system_text(F.try_variant_get(p, "$.text", "string"))
    of_parts = ~F.exists(parts, lambda p: F.coalesce(kind(p) == "tool_result", F.lit(False))) & F.exists(parts, lambda p: F.coalesce(real(p), F.lit(False)))
    of_text = ~T.is_system_text(F.try_variant_get("content", "$", "string"))
    return (F.col("type") == "user") & F.coalesce(F.when(parts.isNotNull(), of_parts).otherwise(of_text), F.lit(False))


def enrich(m: DataFrame) -> DataFrame:
    """text, is_real_user, system_generated (C8), subtype (C4) of raw messages."""
    out = m.withColumn("text", content_text()).withColumn("is_real_user", is_real_user())
    return out.withColumns({"system_generated": (F.col("type") == "user") & ~F.col("is_real_user"), "subtype": T.message_subtype("type", "text", "subtype")})


def classify(m: DataFrame) -> DataFrame:
    """C3, C4, C8 of messages that already have a text."""
    out = m.withColumn("is_real_user", (F.col("type") == "user") & ~T.is_system_text("text"))
    return out.withColumns({"system_generated": (F.col("type") == "user") & ~F.col("is_real_user"), "subtype": T.message_subtype("type", "text", "subtype")})


def instruction_doc(m: DataFrame) -> DataFrame:
    """(S, doc): the last instruction document that a system row quotes."""
    found = m.where("type = 'system' and text rlike 'claudeMd|CLAUDE[.]md'").withColumn("doc", T.strip(F.regexp_extract("text", T.INSTRUCTION_DOC, 1)))
    return found.where(F.col("text").rlike(T.INSTRUCTION_DOC)).groupBy("S").agg(F.max_by("doc", "ord").alias("doc"))


def edit_lines(calls: DataFrame) -> DataFrame:
    """(S, ord, pos, side, line_no, line): old lines, then new ones, of edits with an old text."""
    edits = calls.where((F.col("name") == "Edit") & (field("old_string", "input") != ""))
    side = lambda mark, name: edits.select("S", "ord", "pos", F.lit(mark).alias("side"), F.posexplode(F.split(F.coalesce(field(name, "input"), F.lit("")), "\n")).alias("line_no", "line"))
    return side("-", "old_string").unionByName(side("+", "new_string"))


def display_title(custom: Column, first_message: Column, id: Column) -> Column:
    """B13."""
    return F.coalesce(T.present(custom), T.present(first_message), F.left(id, F.lit(12)))


def pair_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The first call with an id gets the last non-empty result for it."""
    first = Window.partitionBy("S", "id").orderBy("ord", "pos")
    ranked = calls.withColumn("_first", F.col("id").isNotNull() & (F.row_number().over(first) == 1))
    last = results.where("id is not null").groupBy("S", "id").agg(F.max_by("result", F.struct("ord", "pos")).alias("result")).withColumn("_first", F.lit(True))
    return ranked.join(last, ["S", "id", "_first"], "left").drop("_first")
