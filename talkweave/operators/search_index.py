"""K2 over an index: bitmaps of the rows that hold each three characters, built once; what they leave is searched literally."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talkweave.functions.text import once
from talkweave.operators.durable import dropped, stored
from talkweave.operators.search import literal, search

BUCKET = 1 << 15


def folded(text: Column) -> Column:
    """A text in upper case: characters that a search takes as equal become equal, some of them longer."""
    # fixed values: capitals that are no other letter's upper case, though they have a lower case in common with one
    return F.upper(F.translate(text, "İKÅΩẞϴ", "IKÅΩßΘ"))


def _grams(text: Column) -> Column:
    """The different stretches of three characters of a folded text."""
    three = lambda c: F.when(F.size(c) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2])))
    return F.array_distinct(once(F.split(folded(text), ""), three))


def build_index(rows: DataFrame, path: str, order: tuple[str, ...] = ("file", "ord"), text_col: str = "search_text") -> None:
    """Writes ``rows`` and their postings under ``path``. Rows lie in folders of 32,768 each, in ``order``; a posting is three characters and a folder's bitmap of rows."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "rows")
    first, starts = 0, []
    for r in held.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row for each range, as many as tasks
        starts.append((r["_range"], first))
        first += r.n
    numbered = held.join(F.broadcast(spark.createDataFrame(starts, "_range int, _first long")), "_range").withColumn("_n", F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")
    placed = numbered.withColumns({"bucket": (F.col("_n") / BUCKET).cast("long"), "_bit": (F.col("_n") % BUCKET).cast("int")}).drop("_n")
    placed.repartition("bucket").sortWithinPartitions("bucket", "_bit").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    grams = placed.select("bucket", F.col("_bit").cast("long").alias("bit"), F.explode(_grams(F.col(text_col))).alias("gram"))
    maps = grams.groupBy("gram", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    maps.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/postings")
    dropped(held)


def _in_all(bitmaps: str) -> Column:
    """The bits that all of some bitmaps have set."""

    @pandas_udf("array<int>")
    def bits(rows: pd.Series) -> pd.Series:
        return rows.map(lambda maps: np.flatnonzero(np.unpackbits(np.bitwise_and.reduce([np.frombuffer(b, "u1") for b in maps]), bitorder="little")))

    return bits(bitmaps)


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(bucket, bit) of the rows that hold all stretches of three characters of a query; None if it has none."""
    grams = spark.range(1).select(_grams(F.lit(query)).alias("g")).first().g
    if not grams:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(grams)).groupBy("bucket").agg(F.collect_list("bits").alias("maps"))  # at most a bitmap for each
    return found.where(F.size("maps") == len(grams)).select("bucket", F.explode(_in_all("maps")).alias("_bit"))


def search_indexed(spark: SparkSession, path: str, query: str, text_col: str = "search_text") -> DataFrame:
    """K2: what ``search`` finds in the rows of an index. Only folders with candidates are read; queries of less than three characters read all."""
    rows = spark.read.parquet(f"{path}/rows")
    left = candidates(spark, path, query) if query.strip() else None
    if left is not None:
        left = stored(left, "candidates")
        buckets = [r.bucket for r in left.select("bucket").distinct().collect()]  # a number for each 32,768 rows
        rows = rows.where(F.col("bucket").isin(buckets)).join(left, ["bucket", "_bit"], "left_semi").where(F.col(text_col).rlike(literal(query)))
    return search(rows, query, text_col).drop("bucket", "_bit")
