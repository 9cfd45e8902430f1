"""Full-text search over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.operators.messages import content_text, field


def searchable_text(m: DataFrame, parts: DataFrame) -> DataFrame:
    """K1: user and assistant rows with ``search_text``: texts joined by spaces, string tool results, and telling tool inputs."""
    arg = lambda n: F.coalesce(field(f"input.{n}"), F.lit(""))
    tool = F.concat_ws(" ", *(F.nullif(a, F.lit("")) for a in (arg("command"), arg("file_path"), arg("pattern"), F.left(arg("content"), F.lit(500)))))
    bare = F.when(F.schema_of_variant(field("content", kind="variant")) == "STRING", field("content"))
    piece = F.when(field("type") == "text", field("text")).when(field("type") == "tool_result", bare).when(field("type") == "tool_use", tool)
    keys = ["S", "file", "ord"]
    rows = parts.select(*keys, "pos", piece.alias("x")).where("x <> ''")
    per = rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), " ").alias("x"))
    is_string = F.try_variant_get("content", "$", "array<variant>").isNull()
    return m.where("type in ('user', 'assistant')").join(per, keys, "left").withColumn("search_text", F.coalesce(F.when(is_string, content_text()), F.col("x"), F.lit(""))).drop("x")


def literal(query: str) -> str:
    """A pattern that matches the query itself, whatever its case. Characters fold one by one, so a match is as long as the query."""
    return "(?iu)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def snippet(text: Column, query: str, around: int = 60) -> Column:
    """Up to ``around`` characters on either side of the first match, with ``...`` where cut."""
    before = F.regexp_extract(text, f"(?s)^(.*?){literal(query)}", 1)  # its length counts code points, as substring does
    at, n = F.length(before) + 1, len(query)
    start = F.greatest(at - around, F.lit(1))
    end = at + n + around
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))


def search(m: DataFrame, query: str, text_col: str = "search_text") -> DataFrame:
    """K2: rows that hold the query, literally and whatever its case, with a snippet; a blank query finds nothing."""
    if not query.strip():
        return m.limit(0).withColumn("snippet", F.lit(""))
    text = F.col(text_col)
    return m.where(text.rlike(literal(query))).withColumn("snippet", snippet(text, query))


def search_ranked(hits: DataFrame, file_col: str = "file", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """K3: (a file's first ``most`` hits, results by file): ``result_order`` puts them by hits, then the first hit's time."""
    nth = F.row_number().over(Window.partitionBy(file_col).orderBy("ord"))
    kept = hits.withColumn("nth", nth).where(F.col("nth") <= most)
    files = kept.groupBy(file_col).agg(F.count("*").alias("n_hits"), F.min_by("ts", "ord").alias("first_ts"))
    return kept, files


def result_order(files: DataFrame, file_col: str = "file") -> DataFrame:
    return files.orderBy(F.desc("n_hits"), F.desc("first_ts"), file_col)


def search_header(m: DataFrame, file_col: str = "file") -> DataFrame:
    """K4: (file, S, first_user_message): the session id of the first line only, and 200 characters of the first user row."""
    per = m.groupBy(file_col).agg(F.min_by("S", "ord").alias("S"), F.min_by(F.left("text", F.lit(200)), F.when(F.col("type") == "user", F.col("ord"))).alias("first_user_message"))
    return per.where("S is not null").withColumn("first_user_message", F.coalesce("first_user_message", F.lit("")))


def search_totals(kept: DataFrame, file_col: str = "file") -> DataFrame:
    """(files, hits) of a search's hits."""
    return kept.agg(F.countDistinct(file_col).alias("files"), F.count("*").alias("hits"))


def occurrences(text: Column, query: str) -> Column:
    """How often a text holds the query, overlaps included, whatever its case."""
    return F.regexp_count(text, F.lit(f"(?={literal(query)})"))


def search_in_session(sectioned: DataFrame, query: str) -> DataFrame:
    """K5: (S, section_no, hits, occurrences) of sections that hold the trimmed query."""
    q = query.strip()
    if not q:
        return sectioned.select("S", "section_no", F.lit(0).alias("hits"), F.lit(0).alias("occurrences")).limit(0)
    found = sectioned.where(F.col("text").rlike(literal(q)))
    return found.groupBy("S", "section_no").agg(F.count("*").alias("hits"), F.sum(occurrences(F.col("text"), q)).alias("occurrences"))
