"""Aggregates over messages and tool calls. Messages need text, is_real_user and the envelope columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators.messages import part_image_path_refs, tool_calls


def _when(cond: Column, value) -> Column:
    return F.when(cond, value)


def session_summary(m: DataFrame, by: tuple[str, ...] = ("S",)) -> DataFrame:
    """A row for each session (or cluster) with a valid message.

    Counts include sidechains; created and updated come from the main chain's timestamps as
    strings, or from all rows if it has none. The initial directory is that of the
    smallest main-chain timestamp, then line. All in one aggregation, without a sort.
    """
    kind, text, ts = F.col("type"), F.col("text"), F.col("ts")
    main = ~F.coalesce("is_sidechain", F.lit(False))
    valid, user = kind.isin("user", "assistant", "system"), kind == "user"
    first = lambda cond, value: F.min_by(value, _when(cond, F.col("ord")))
    last = lambda cond, value: F.max_by(value, _when(cond, F.col("ord")))
    meaningful = user & T.is_meaningful_first("text")
    out = m.groupBy(*by).agg(
        F.coalesce(F.min(_when(main, ts)), F.min(ts)).alias("created_at"), F.coalesce(F.max(_when(main, ts)), F.max(ts)).alias("updated_at"),
        F.count_if(valid).alias("message_count"), F.count_if(F.col("is_real_user")).alias("users"), F.count_if(kind == "assistant").alias("assistants"),
        F.count_if((kind == "system") & (F.col("subtype") == "compact_boundary")).alias("compact_count"),
        F.min_by("cwd", _when(main & F.col("cwd").isNotNull() & ts.isNotNull(), F.struct("ts", "ord"))).alias("initial_cwd"),
        last(F.col("permission_mode").isNotNull(), "permission_mode").alias("permission_mode"), last(F.col("version").isNotNull(), "version").alias("version"),
        first(F.col("slug").isNotNull(), "slug").alias("slug"),
        F.left(F.coalesce(first(meaningful, text), first(user, text), F.lit("")), F.lit(200)).alias("first_user_message"),
    )
    return out.where("message_count > 0").withColumn("turn_count", F.least("users", "assistants")).drop("users", "assistants")


def distinct_in_order(m: DataFrame, column: str) -> DataFrame:
    """(S, values): the distinct values of a column in order of first appearance."""
    seen = m.where(F.col(column).isNotNull()).groupBy("S", column).agg(F.min("ord").alias("at"))
    return seen.groupBy("S").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", column))), lambda x: x[column]).alias("values"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """(S, tool, n, first_ord) of assistants' calls; calls have message_type."""
    return calls.where("message_type = 'assistant'").groupBy("S", F.col("name").alias("tool")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def top_tools(usage: DataFrame, k: int = 6) -> DataFrame:
    """H2."""
    rank = F.row_number().over(Window.partitionBy("S").orderBy(F.desc("n"), "first_ord", "tool"))
    return usage.withColumn("rank", rank).where(F.col("rank") <= k)


def token_totals(usage: DataFrame, by: tuple[str, ...] = ("S",)) -> DataFrame:
    """E5, of assistants' rows; E6 with turn numbers in ``by``. usage has the message's type."""
    return usage.where("type = 'assistant'").groupBy(*by).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input", "output", "cache_creation", "cache_read")))


def turn_tokens(usage: DataFrame, by: tuple[str, ...] = ("S", "turn_no")) -> DataFrame:
    """Input counts cache writes and reads too."""
    t = token_totals(usage, by)
    return t.select(*by, (F.col("input") + F.col("cache_creation") + F.col("cache_read")).alias("input"), "output")


def file_actions(actions: DataFrame) -> DataFrame:
    """(S, path, actions, first_ord) of absolute paths; actions: (S, ord, path, action)."""
    return actions.where(F.col("path").startswith("/")).groupBy("S", "path").agg(F.sort_array(F.collect_set("action")).alias("actions"), F.min("ord").alias("first_ord"))


def call_actions(calls: DataFrame) -> DataFrame:
    """(S, ord, path, action) of assistants' reads, writes and edits."""
    return calls.where(F.col("name").isin("Read", "Write", "Edit") & (F.col("message_type") == "assistant")).select("S", "ord", F.try_variant_get("input", "$.file_path", "string").alias("path"), F.lower("name").alias("action"))


def session_file_actions(parts: DataFrame) -> DataFrame:
    """E8 of messages' parts: assistants' file tools, and the image paths that users' parts name, as ``user-image``."""
    shown = part_image_path_refs(parts).select("S", "ord", "path", F.lit("user-image").alias("action"))
    return file_actions(call_actions(tool_calls(parts)).unionByName(shown))


def notable_files(refs: DataFrame) -> DataFrame:
    """Written, edited or shown by the user, or read and more."""
    return refs.where(F.arrays_overlap("actions", F.array(*map(F.lit, ("write", "edit", "user-image")))) | (F.size("actions") > 1))


def file_existence(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """D9."""
    return refs.join(inventory.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def file_order(refs: DataFrame) -> DataFrame:
    """H3: place of each file in its session: existing first, then writes, edits, others, by first use."""
    priority = F.when(F.array_contains("actions", "write"), 0).when(F.array_contains("actions", "edit"), 1).otherwise(2)
    return refs.withColumn("place", F.row_number().over(Window.partitionBy("S").orderBy(F.desc("exists"), priority, "first_ord", "path")))


def config_file_candidates(
    cwds: DataFrame, inventory: DataFrame, names: tuple[str, ...], top_only: tuple[str, ...] = (), levels: int = 10, home: str = "/root",
    project: str | None = None, project_names: tuple[str, ...] = (), root_only: tuple[str, ...] = (),
) -> DataFrame:
    """(path, level) of existing configuration files in a directory and its ancestors; ``top_only`` names only count at level 0.

    The walk up ends at / and at ``home``, whose own files and those above it don't count. Files of the folder ``project`` (``project_names``)
    have level -2, those of the project's root, which the folder's name spells with dashes, level -1 (``names``, ``top_only`` and ``root_only``), unless that is
    / or home. Each path comes once, with its lowest level: ordered by it, the project's files come first.
    """
    parts = F.filter(F.split("cwd", "/"), lambda p: p != "")
    ups = F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(levels - 1)))
    dirs = cwds.where("cwd like '/_%'").select("cwd", parts.alias("p"), F.explode(ups).alias("level")).select(
        "cwd", "level", F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.size("p") - F.col("level")), "/")).alias("dir")
    )
    inside = (F.col("cwd") == home) | F.col("cwd").startswith(home.rstrip("/") + "/")
    over = (F.col("dir") == home) | F.lit(home).startswith(F.concat("dir", F.lit("/")))
    named = dirs.where(~(inside & over)).select("level", "dir", F.explode(F.array(*map(F.lit, names + top_only))).alias("name")).where(~F.col("name").isin(*top_only) | (F.col("level") == 0))
    found = named.select(F.concat("dir", F.lit("/"), "name").alias("path"), "level")
    if project:
        own = [(f"{project}/{n}", -2) for n in project_names]
        folder = project.rstrip("/").rsplit("/", 1)[-1]
        root = (("/" + folder[1:]) if folder.startswith("-") else folder).replace("-", "/")
        if root not in ("", "/", home):
            own += [(f"{root}/{n}", -1) for n in (*names, *top_only, *root_only)]
        if own:
            found = found.unionByName(cwds.sparkSession.createDataFrame(own, "path string, level int"))
    return found.groupBy("path").agg(F.min("level").alias("level")).join(inventory.select("path").distinct(), "path", "left_semi")


def file_tree(refs: DataFrame) -> DataFrame:
    """(S, path, name, parent, depth, is_file, n_files, n_existing, n_deleted, place): the nodes that a tree of files shows; refs: (S, path, exists).

    A directory that is no file itself and has one child is shown as one with it, under joined
    names. parent is the shown node above (null at the top). Among siblings directories come
    before files, then names; counts are of the files at and below a node.
    """
    key = lambda p: F.concat(F.lit("/"), F.array_join(p, "/"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    own = refs.select("S", parts.alias("p"), "exists").groupBy("S", "p").agg(F.bool_or("exists").alias("exists")).where("size(p) > 0")
    up = own.select("S", "p", "exists", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    up = up.select("S", "exists", "level", F.slice("p", F.lit(1), F.col("level")).alias("q"), F.get("p", F.col("level")).alias("child"))
    nodes = up.groupBy("S", "q", "level").agg(
        F.count("*").alias("n_files"), F.count_if("exists").alias("n_existing"), F.min("child").alias("least"), F.max("child").alias("most"), F.bool_or(F.col("child").isNull()).alias("is_file")
    )
    shown = nodes.where("is_file or least <> most")
    above = F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("at")
    ways = shown.where("level > 1").select("S", "q", above).select("S", "q", key(F.slice("q", F.lit(1), F.col("at"))).alias("up"), "at")
    nearest = ways.join(shown.select("S", key("q").alias("up")), ["S", "up"]).groupBy("S", "q").agg(F.max("at").alias("from"), F.count("*").alias("depth"))
    out = shown.join(nearest, ["S", "q"], "left").withColumns({"from": F.coalesce("from", F.lit(0)), "depth": F.coalesce("depth", F.lit(0))})
    out = out.select(
        "S", key("q").alias("path"), F.array_join(F.slice("q", F.col("from") + 1, F.col("level") - F.col("from")), "/").alias("name"),
        F.when(F.col("from") > 0, key(F.slice("q", F.lit(1), F.col("from")))).alias("parent"), "depth", "is_file", F.col("least").isNull().alias("leaf"), "n_files", "n_existing",
    )
    place = F.row_number().over(Window.partitionBy("S", "parent").orderBy("leaf", "name"))
    return out.withColumns({"n_deleted": F.col("n_files") - F.col("n_existing"), "place": place}).drop("leaf")


def corpus_stats(summary: DataFrame, size_col: str) -> DataFrame:
    """E10."""
    return summary.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(size_col), F.lit(0)).alias("total"))
