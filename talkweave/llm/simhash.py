"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talkweave.llm.common import connected_components, discard, document_keys, saved

_BLOCK = 65_536


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint, as a signed integer, of the shingles of ``words`` words, repeats included.

    A-Z are lower-cased; words are separated by space and bytes 9 to 13. A text of fewer
    words is one shingle; a text without words, like a null one, has fingerprint 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    ones, h = np.zeros(64, "i8"), xxhash.xxh64_intdigest
    for a in range(0, n, _BLOCK):
        got = np.array([h(line[x:y], 42) for x, y in zip(starts[a : a + _BLOCK].tolist(), stops[a : a + _BLOCK].tolist())], ">u8")
        ones += np.unpackbits(got.view("u1").reshape(-1, 8), axis=1).sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row."""
    return docs.select(id_col, _fingerprint(F.coalesce(text_col, F.lit("")), words).alias("fp"))


def _fingerprint(text, words: int):
    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: simhash(t, words)).astype("int64")

    return fp(text)


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits lie outside one of them at least.

    Bit i gets a non-zero vector of radius+1 binary digits; the mask of each non-zero v
    holds the bits whose vector has odd overlap with v. To any ``radius`` vectors of that
    space some non-zero v is orthogonal, and its mask holds none of their bits.
    """
    space = 1 << (radius + 1)
    vector = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs_across(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """(src, dst): components of which two fingerprints of a bucket are near; rows: (t, key, fp, component).

    A bucket's rows are dealt into blocks of about ``block``, and blocks meet in pairs, each in a key of its own.
    """
    blocks = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    left = dealt.select("t", "key", F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"), "fp", "component")
    right = dealt.select("t", "key", F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"), F.col("fp").alias("fp2"), F.col("component").alias("component2"))
    near = (F.col("component") != F.col("component2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    met = left.join(right, ["t", "key", "lo", "hi"]).where(near)
    return met.select(F.greatest("component", "component2").alias("src"), F.least("component", "component2").alias("dst")).distinct()


def link_fingerprints(fps: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """(id, component), saved, over the column ``fp`` of distinct fingerprints: components under at most ``radius`` differing bits.

    Every pair within the radius shares a bucket of some mask. A bucket first links its
    members to its smallest one. Pairs are then compared only where a bucket still holds
    several components, only across them and in pairs of blocks, so that a dense ball of
    fingerprints costs rows in proportion to its size and no bucket is one task. No bucket is
    capped: the components are exact.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))).alias("b")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    rows = saved(fps.select("fp", tables).select("b.t", "b.key", "fp"), "buckets")
    centers = rows.groupBy("t", "key").agg(F.min("fp").alias("center"), F.max("fp").alias("other")).where("center <> other").drop("other")
    first = saved(
        rows.join(centers, ["t", "key"]).where(F.col("fp") != F.col("center")).where(near("fp", "center"))
        .select(F.col("fp").alias("src"), F.col("center").alias("dst")).distinct(),
        "links",
    )
    found = connected_components(first)
    labelled = rows.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    mixed = labelled.groupBy("t", "key").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("t", "key")
    open_rows = saved(labelled.join(mixed, ["t", "key"]), "mixed")
    second = _pairs_across(open_rows, radius, block)
    joined = connected_components(second)
    out = (
        fps.select(F.col("fp").alias("id"))
        .join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        .join(joined.withColumnRenamed("id", "c"), "c", "left")
        .select("id", F.coalesce("component", "c").alias("component"))
    )
    out = saved(out, "components")
    for t in (rows, first, found, open_rows, joined):
        discard(t)
    return out


def _components(own: DataFrame, id_col: str, radius: int, *order: str) -> DataFrame:
    """(fp, least): the first row of each fingerprint's component by ``order``, null ids last; own: stored rows with fp."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), *order))
    linked = link_fingerprints(own.select("fp").distinct(), radius)
    by_fp = saved(own.groupBy("fp").agg(first.alias("least")).join(linked.withColumnRenamed("id", "fp"), "fp"), "by_fp")
    least = by_fp.groupBy("component").agg(F.min("least").alias("least"))
    out = saved(by_fp.drop("least").join(least, "component").select("fp", "least"), "components")
    for t in (linked, by_fp):
        discard(t)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, words: int = 3) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other; repeated ids stay
    repeated, each row with its own text's fingerprint; rows with a null id are kept, and have
    their component's smallest other id. Other columns don't matter; no rows give no rows.
    """
    own = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    found = _components(own, id_col, radius, id_col)
    return own.join(found, "fp").select(id_col, "fp", F.col(f"least.{id_col}").alias("component_id"))


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, words: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, rows of that id by a hash of the text.

    Null ids come last. Of rows that repeat both id and text any one stays. Other columns may have any name.
    """
    keys = docs.select(F.col(id_col).alias("id"), *document_keys(F.col(id_col), F.col(text_col)), F.coalesce(text_col, F.lit("")).alias("t"))
    own = saved(keys.select("id", "r1", "r2", _fingerprint("t", words).alias("fp")), "fingerprints")
    kept = _components(own, "id", radius, "id", "r1", "r2")
    repeated = saved(own.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2", F.lit(True).alias("again")), "repeated")
    stay = saved(kept.select("least.r1", "least.r2").distinct().join(repeated, ["r1", "r2"], "left"), "stay")
    rows = docs.select(F.struct("*").alias("row"), *document_keys(F.col(id_col), F.col(text_col))).join(stay.hint("shuffle_hash"), ["r1", "r2"])
    if not repeated.isEmpty():
        rows = rows.where("again is null").unionByName(rows.where("again").dropDuplicates(["r1", "r2"]))
    for t in (own, kept, repeated):
        discard(t)
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
