"""Log files as streams: new and active sessions, live summaries and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkweave.operators.durable import dropped, stored
from talkweave.operators.export import tool_lines, tool_summary, transcript_compact, write_backup
from talkweave.operators.library import library_rows
from talkweave.operators.messages import enrich, explode_parts, tool_calls
from talkweave.operators.summary import session_summary, tool_usage
from talkweave.sources.logs import json_objects, normalize_messages
from talkweave.streaming.activity import IDLE, live_events
from talkweave.streaming.store import Store


def stream_logs(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """L1: the columns of ``normalize_messages`` (ord is null), with block, the raw line and time, of lines in files that land under ``root``/<folder>/.

    Files are read once, when they appear: producers land chunks and don't append. ``numbered``
    gives the lines of a batch their order.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys wins
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(f"{root}/*/*.jsonl").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    kept = normalize_messages(json_objects(raw.withColumn("raw", F.col("value"))).withColumn("ord", F.lit(None).cast("long")), "block", "raw")
    return kept.withColumn("time", F.to_timestamp("ts")).where("S is not null")


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    """A batch's rows with ord: later batches after earlier ones, then by file, block and line."""
    order = Window.partitionBy("S").orderBy("file", "block", "_line")
    lines = rows.withColumn("_line", F.monotonically_increasing_id())
    return lines.withColumn("ord", F.lit(batch).cast("long") * (1 << 32) + F.row_number().over(order)).drop("_line")


def new_sessions(messages: DataFrame) -> DataFrame:
    """L2: (S, time): when each session was first seen; in a stream, once ever (``live_events`` also says when it comes again)."""
    if not messages.isStreaming:
        return messages.groupBy("S").agg(F.min("time").alias("time"))
    return live_events(messages).where("event = 'added'").select("S", F.col("at").alias("time"))


def active_sessions(messages: DataFrame, idle: str = IDLE) -> DataFrame:
    """L3: (S, first, until, n): spells of activity of stored messages; a session is active before ``until``, the last activity plus ``idle``.

    A stream says as it happens who is active with ``live_events``.
    """
    spells = messages.groupBy(F.session_window("time", idle), "S").agg(F.count("*").alias("n"))
    return spells.select("S", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def active_at(spells: DataFrame, now) -> DataFrame:
    """Sessions active at a time: strictly less than the idle time after their last message."""
    return spells.where((F.col("first") <= now) & (F.col("until") > now)).select("S").distinct()


def active_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(S, change): sessions that became active or idle; empty if the sets are the same."""
    return after.exceptAll(before).withColumn("change", F.lit("active")).unionByName(before.exceptAll(after).withColumn("change", F.lit("idle")))


def _stores(spark: SparkSession, root: str, fanout: int) -> tuple[Store, Store]:
    return Store(spark, f"{root}/messages", order=("file", "ord"), fanout=fanout), Store(spark, f"{root}/sessions", replaces=True, fanout=fanout)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The rows that ``live_summary`` keeps (``library_rows``), as of its newest version."""
    return Store(spark, f"{root}/sessions", replaces=True).read().drop("slot", "written")


def read_messages(spark: SparkSession, root: str, sessions: DataFrame | None = None) -> DataFrame:
    """The messages that ``live_summary`` has stored, of all sessions or of those in ``sessions`` (S)."""
    return enrich(Store(spark, f"{root}/messages").read(sessions).drop("slot", "written"))


def live_summary(
    messages: DataFrame, root: str, checkpoint: str, interval: str = "500 milliseconds", after: Callable[[DataFrame, int], None] | None = None, fanout: int = 8
) -> StreamingQuery:
    """Keeps the rows of sessions, clusters and branches current; messages: of ``stream_logs``.

    Each micro-batch (bursts within ``interval`` come together) adds its messages to a ``Store`` and makes the rows of the sessions
    that it touches anew, from their own stored messages; these rows stand for the sessions' earlier ones. What is read follows
    the touched sessions, and what is written a batch, but for merges. A repeated batch changes nothing that it has done already. ``after`` gets the
    touched sessions' messages, as for exports.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        log, table = _stores(spark, root, fanout)
        log.append(numbered(rows, number).drop("block", "time"), number)
        touched = stored(rows.select("S").distinct(), "touched")
        seen = enrich(log.read(touched).drop("slot", "written"))
        table.append(library_rows(seen), number)
        if after:
            after(seen, number)
        dropped(touched)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def stream_exports(root: str, backups: str | None = None, fanout: int = 8) -> Callable[[DataFrame, int], None]:
    """For ``live_summary``: the current transcripts (N1, tools included) of all sessions under ``root``, and backups (A5).

    A touched session's transcript stands for its earlier one (``read_exports``). ``backups`` is a folder with a folder for each
    session, whose raw lines, file by file, are replaced as a whole; other sessions' folders stay.
    """

    def export(seen: DataFrame, number: int) -> None:
        calls = tool_calls(explode_parts(seen.withColumn("file", F.coalesce("file", F.lit("")))))
        head = session_summary(seen).join(tool_summary(tool_usage(calls)), "S", "left").select("S", F.left("first_user_message", F.lit(60)).alias("title"), "created_at", "turn_count", "tools")
        documents = transcript_compact(seen, head, tool_lines(calls).select("S", "ord", "pos", "line"))
        Store(seen.sparkSession, root, replaces=True, fanout=fanout).append(documents, number)
        if backups:
            lines = seen.select("S", F.col("file").alias("file_no"), "ord", F.col("raw").alias("value"))
            write_backup(lines, backups, replace_all=False)

    return export


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    """(S, markdown): the current transcript of each session that ``stream_exports`` has seen."""
    return Store(spark, root, replaces=True).read().drop("slot", "written")
