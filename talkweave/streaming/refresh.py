"""A2: stored rows of unchanged files are used again; only what changed files touch is read and made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators.durable import dropped, stored
from talkweave.operators.library import library_rows
from talkweave.operators.messages import enrich
from talkweave.sources.logs import exclude_subagents, file_manifest, manifest_diff, normalize_messages, scan_logs
from talkweave.streaming.store import Store


def _uri(column: str):
    """One form of local paths; readers write them in two."""
    return F.regexp_replace(column, "^file:/+", "file:///")


def _stores(spark: SparkSession, out: str) -> tuple[Store, Store]:
    return Store(spark, f"{out}/files", key="path", replaces=True), Store(spark, f"{out}/sessions", replaces=True)


def _known(files: Store) -> DataFrame:
    """(path, mtime, size, S): the files as they were read last, a row for each session in them (S is null without one)."""
    if not files.snapshot().schema:
        return files.spark.createDataFrame([], "path string, mtime timestamp, size long, S string")
    return files.read().where("not gone").select("path", "mtime", "size", "S")


def read_library(spark: SparkSession, out: str) -> DataFrame:
    """The rows (``library_rows``) that ``refresh`` keeps under ``out``."""
    return _stores(spark, out)[1].read().where("id is not null").drop("slot", "written")


def refresh(spark: SparkSession, root: str, out: str) -> list[str]:
    """Brings the rows under ``out`` up to the log files under ``root``; gives the paths that were read, none if no file changed.

    Files are compared by path, time and size with those that were read last. Read are files that are new or changed, and the other
    files of the sessions that those, or files that went, touch. The rows of these sessions are replaced, or go if nothing of them is left; all
    other rows stay as they are stored. A run that failed is made up for by the next one.
    """
    files, sessions = _stores(spark, out)
    now = exclude_subagents(file_manifest(spark, root).withColumn("path", _uri("path")), "path")
    known = _known(files)
    diff = stored(manifest_diff(known.select("path", "mtime", "size").distinct(), now), "diff")
    if diff.isEmpty():
        dropped(diff)
        return []
    fresh = diff.where("change <> 'removed'").join(now, "path").select("path", "mtime", "size")
    before = known.join(diff, "path", "left_semi").select("S").where("S is not null")
    paths = sorted(r.path for r in fresh.select("path").collect())  # as Spark's own list of the files to read
    found = stored(_messages(spark, root, paths).select("file", "S").distinct(), "found") if paths else None
    touched = before.unionByName(found.select("S").where("S is not null")) if found else before
    touched = stored(touched.distinct(), "touched")
    others = known.join(diff, "path", "left_anti").join(touched, "S", "left_semi")
    paths = sorted({*paths, *(r.path for r in others.select("path").distinct().collect())})
    m = _messages(spark, root, paths) if paths else None
    if m is not None:
        rows = stored(library_rows(enrich(m.join(touched, "S", "left_semi"))), "rows")
        gone = touched.join(rows.select("S"), "S", "left_anti")
        rows_now = rows.unionByName(gone, allowMissingColumns=True)
    else:
        rows_now = touched.join(spark.createDataFrame([], sessions.read().drop("slot", "written").schema), "S", "left") if sessions.snapshot().schema else None
    if rows_now is not None:
        sessions.append(rows_now, sessions.snapshot().batch + 1)
    read = fresh.join(found.withColumnRenamed("file", "path"), "path", "left") if found else fresh.withColumn("S", F.lit(None).cast("string"))
    went = diff.where("change = 'removed'").select("path").withColumns({"mtime": F.lit(None).cast("timestamp"), "size": F.lit(None).cast("long"), "S": F.lit(None).cast("string")})
    files.append(read.select("path", "mtime", "size", "S").withColumn("gone", F.lit(False)).unionByName(went.withColumn("gone", F.lit(True))), files.snapshot().batch + 1)
    dropped(diff, touched, *(t for t in (found, rows if m is not None else None) if t))
    return paths


def _messages(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    m = normalize_messages(scan_logs(spark, root, paths)).withColumn("file", _uri("file"))
    return m.where("S is not null")
