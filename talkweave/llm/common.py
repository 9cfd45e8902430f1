"""Tables, durable intermediate results and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder. Python functions get at most 1,000 rows at once: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it; a folder of our own in a local session without one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # Spark deletes shuffle files of finished jobs once their objects are gone
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``saved`` wrote and that nothing reads any more."""
    spark, path = df.sparkSession, df.saved_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def few_or_shuffled(df: DataFrame, most: int = 1 << 19) -> DataFrame:
    """A side of a join on keys of at most 16 bytes: broadcast if it has at most ``most`` rows, else hashed where both sides meet."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def document_keys(id_: Column, text: Column) -> list[Column]:
    """128 bits over the id and the text, as r1 and r2."""
    return [F.xxhash64(id_, text).alias("r1"), F.xxhash64(F.lit(1), text, id_).alias("r2")]


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, t): ids as strings, so that nulls and large integers pass Python unchanged; null texts are empty."""
    return docs.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def restore_key(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``df`` with its first column, ``k``, as the id of ``docs`` again."""
    return df.select(F.col("k").cast(docs.schema[id_col].dataType).alias(id_col), *df.columns[1:])


def held_out(id_col: str, part: int = 1, of: int = 3):
    """Rows that nothing is learned from: those whose crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def text_batches(texts: list[str], most: int = 512, chars: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of at most ``most`` texts that hold ``chars`` characters together, or a single longer text."""
    part, n = [], 0
    for t in texts:
        if part and (len(part) == most or n + len(t) > chars):
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component), saved, for every node of ``edges``; component is the smallest id reachable.

    Alternating large-star and small-star rounds: each node's neighbours move to its
    smallest neighbour, until the edge set no longer changes. Minima are aggregated
    before they are joined, so a hub costs one row a task in the aggregate and an
    ordinary (splittable) join. Nulls, self-loops and repeats are ignored.
    """
    u, v = F.col(src), F.col(dst)
    e = saved(
        edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = saved(small, "edges")
        discard(e)
        e = new
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    out = saved(
        e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()),
        "components",
    )
    discard(e)
    return out
