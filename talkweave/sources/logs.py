"""Log files, their manifest and annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from talkweave.functions.text import present


def scan_logs(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """A1: (file, ord, v) of one JSON object a line, in files one folder below ``root``, or in those of ``paths`` only.

    Blank and malformed lines and lines that aren't objects are left out. ord is dense in
    file order: blocks of a file in order, and lines of a block by their running id.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys wins
    raw = spark.read.text(f"{root}/*/*.jsonl" if paths is None else paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    order = F.row_number().over(Window.partitionBy("file").orderBy("block", "line"))
    return json_objects(raw).select("file", order.alias("ord"), "v")


def json_objects(raw: DataFrame) -> DataFrame:
    """Rows whose column ``value`` is a JSON object, as the variant v."""
    whole = raw.where(F.trim("value").startswith("{") & F.rtrim("value").endswith("}"))
    return whole.withColumn("v", F.try_parse_json(F.trim("value"))).where("v is not null and schema_of_variant(v) like 'OBJECT%'").drop("value")


def exclude_subagents(df: DataFrame, file_col: str = "file") -> DataFrame:
    """C2."""
    return df.where(~F.col(file_col).contains("/subagents/"))


def normalize_messages(raw: DataFrame, *keep: str) -> DataFrame:
    """B1: the envelope as columns, and the columns ``keep``; empty strings are absent. content stays a variant."""
    s = lambda path: present(F.try_variant_get("v", f"$.{path}", "string"))
    n = lambda path: F.coalesce(F.try_variant_get("v", f"$.message.usage.{path}", "bigint"), F.lit(0))
    has_usage = F.try_variant_get("v", "$.message.usage", "variant").isNotNull()
    return raw.select(
        *keep, "file", "ord", s("uuid").alias("uuid"), s("parentUuid").alias("parent"), s("logicalParentUuid").alias("logical_parent"), s("sessionId").alias("S"),
        s("type").alias("type"), s("subtype").alias("subtype"), s("timestamp").alias("ts"), s("cwd").alias("cwd"), s("version").alias("version"), s("slug").alias("slug"),
        s("permissionMode").alias("permission_mode"), F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        s("forkedFrom.sessionId").alias("fork_session"), s("forkedFrom.messageUuid").alias("fork_message"), s("message.role").alias("role"),
        F.try_variant_get("v", "$.message", "variant").isNotNull().alias("has_message"),
        F.when(F.try_variant_get("v", "$.message", "variant").isNotNull(), F.try_variant_get("v", "$.message.content", "variant")).otherwise(F.try_variant_get("v", "$.content", "variant")).alias("content"),
        F.when(has_usage, F.struct(n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cache_creation_input_tokens").alias("cache_creation"), n("cache_read_input_tokens").alias("cache_read"))).alias("usage"),
    )


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A2: (path, mtime, size)."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.jsonl")
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """A2: (path, change) of files that are added, changed or removed."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    change = (
        F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed")
        .when(~(F.col("o.mtime").eqNullSafe(F.col("n.mtime")) & F.col("o.size").eqNullSafe(F.col("n.size"))), "changed")
    )
    return j.select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change")).where("change is not null")


_HIGHLIGHT = "struct<id:string,text:string,turnUuid:string,note:string,createdAt:string>"
_META = f"map<string, struct<customTitle:string,notes:string,highlights:array<{_HIGHLIGHT}>>>"
_ANNOTATIONS = (
    "folders array<struct<id:string,name:string,parentId:string,color:string,createdAt:string,sessionIds:array<string>>>, "
    f"sessionMeta {_META}, branchMeta {_META}, branchFolders map<string, array<string>>, folderOrder array<string>"
)


def load_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A3: folders, folder_order, folder_members, session_meta, highlights, branch_members, branch_meta and branch_highlights.

    ``path`` is a configuration file or a folder or pattern of them (one for the sessions, one for
    the library). A missing or broken file gives empty tables.
    """
    try:
        doc = spark.read.schema(_ANNOTATIONS).json(path, multiLine=True)
        doc.take(1)
    except AnalysisException:
        doc = spark.createDataFrame([], _ANNOTATIONS)
    folders = doc.select(F.explode("folders").alias("f")).select("f.*")
    out = {
        "folders": folders.drop("sessionIds"),
        "folder_order": doc.select(F.posexplode("folderOrder").alias("pos", "id")),
        "folder_members": folders.select(F.col("id").alias("folder_id"), F.posexplode("sessionIds").alias("pos", "member_id")),
        "branch_members": doc.select(F.explode("branchFolders").alias("member_id", "f")).select(F.explode("f").alias("folder_id"), "member_id"),
    }
    for name, field, notes in (("session_meta", "sessionMeta", "highlights"), ("branch_meta", "branchMeta", "branch_highlights")):
        meta = doc.select(F.explode(field).alias("id", "m")).select("id", "m.*")
        out[name] = meta.drop("highlights")
        out[notes] = meta.select(F.col("id").alias("session_id"), F.posexplode("highlights").alias("pos", "h")).select("session_id", "pos", "h.*")
    return out
