"""Document fingerprints: bottom-k sketches of word-shingle hashes, mergeable, with estimates of resemblance, containment and counts."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

K, WORDS = 128, 5
_SLICE = 1 << 20
_KNOWN_WORDS = 1 << 19
_SPACES = b" \t\n\r\x0b\x0c"
_NONE = np.empty(0, "u8")
_OVER = 2.0**64


class _WordHashes(dict):
    """XXH64 of words, kept for those met again; forgotten all at once beyond a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) < 64:
            self[word] = h
        return h


_hash_of = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words that follow each other; of all words, if they are fewer."""
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, "u8")
    for k in range(n):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


def _lowest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest different hashes, rising."""
    if len(hashes) > 4 * k:
        for room in (2 * k, len(hashes)):  # repeats may leave fewer than k among the smallest 2 k
            part = np.unique(np.partition(hashes, room - 1)[:room] if room < len(hashes) else hashes)
            if len(part) >= k:
                return part[:k]
        return part
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k smallest different hashes of a text's shingles of ``words`` words.

    A-Z are lower-cased, words are separated by space and bytes 9 to 13. Fewer words are one shingle; a text without words
    has an empty sketch. A text is read in slices, and the last words of a slice go with the next one.
    """
    data = (text or "").encode()
    low, tail, held = _NONE, _NONE, b""
    for a in range(0, max(len(data), 1), _SLICE):
        part, last = held + data[a : a + _SLICE].lower(), a + _SLICE >= len(data)
        found = part.split()
        held = b""
        if not last and found and part[-1:] not in _SPACES:
            held = found.pop()
        got = np.fromiter(map(_hash_of.__getitem__, found), "u8", len(found))
        got = np.concatenate([tail, got])
        if len(got) >= words or last and len(low) == 0 and len(got):
            low = _lowest(np.concatenate([low, _combined(got, words)]), k)
            tail = got[len(got) - words + 1 :]
        else:
            tail = got
    return low


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of all shingles of several sketched parts."""
    return _lowest(np.concatenate([_NONE, *sketches]), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of all shingles of two texts; exact while both together have at most k, 1 for two empty ones."""
    both = merge(a, b, k=k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _OVER / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of the first one's shingles that the second has too; 1 for an empty first one."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k)
    return min(1.0, shared / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, rising, eight bytes each."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), ">u8").astype("u8")


def fingerprint(text: Column, k: int = K, words: int = WORDS) -> Column:
    """A column of fingerprints of texts."""

    @pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(sketch(t, k, words)))

    return made(F.coalesce(text, F.lit("")))


def estimates(a: Column, b: Column, k: int = K) -> Column:
    """(resemblance, containment, distinct_a, distinct_b) of two columns of fingerprints."""

    @pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def made(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(resemblance(p, q, k), containment(p, q, k), distinct_count(p, k), distinct_count(q, k)) for p, q in zip(map(from_text, x), map(from_text, y))]
        return pd.DataFrame(rows, columns=["resemblance", "containment", "distinct_a", "distinct_b"])

    return made(a, b)


def merged(parts: DataFrame, key: str, fingerprint_col: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """(key, fingerprint): the fingerprint of all parts of each key, null keys as one.

    A key's parts are merged under ``salts`` salts first, so that a key of very many parts isn't one task's work;
    a task streams over sorted rows and holds one sketch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            out = []
            for row in zip(b["none"], b["key"], b["salt"], b["f"]):
                if at is not None and row[:3] != at:
                    out.append((*at, to_text(merge(*held, k=k))))
                    held = []
                at = row[:3]
                held.append(from_text(row[3]))
                if len(held) == 64:
                    held = [merge(*held, k=k)]
            yield pd.DataFrame(out, columns=["none", "key", "salt", "f"])
        if at is not None:
            yield pd.DataFrame([(*at, to_text(merge(*held, k=k)))], columns=["none", "key", "salt", "f"])

    name, types = ["none", "key", "salt"], "none boolean, key string, salt int, f string"
    rows = parts.select(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.pmod(F.xxhash64(fingerprint_col), F.lit(salts)).cast("int").alias("salt"), F.coalesce(fingerprint_col, F.lit("")).alias("f"))
    for salt in (F.col("salt"), F.lit(0)):
        rows = rows.withColumn("salt", salt).repartition(*name).sortWithinPartitions(*name).mapInPandas(run, types)
    return rows.select(F.when(~F.col("none"), F.col("key")).cast(parts.schema[key].dataType).alias(key), F.col("f").alias(fingerprint_col))


def _order_key(docs: DataFrame, id_col: str) -> Column:
    """What ids are ordered by: whole numbers as such, all others as strings."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Rows (part, own, has_id, key, tie, id, t), a task for each part, in order: in front of a part's own rows stands, with own 0, the row before them.

    Rows rise by id, null ids first, then by a hash of the text; before the first row comes the last one. Two passes read ids
    and hashes only: Spark's range partitioning gives the parts' bounds, and each part's last row is looked up; then the texts are
    shuffled once. ``tasks``: how many parts, the session's shuffle partitions by default; so many bounds are held by the driver.
    """
    spark = docs.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(text_col, F.lit(""))
    order = ["has_id", "key", "tie"]
    keys = docs.select(F.col(id_col).isNotNull().alias("has_id"), _order_key(docs, id_col).alias("key"), F.xxhash64(text).alias("tie"))
    kind = keys.schema["key"].dataType.simpleString()
    ends = keys.repartitionByRange(tasks, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*order)).alias("last")).select("last.*").collect()
    bounds = sorted(map(tuple, ends))

    @pandas_udf("int")
    def part_of(has_id: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        at = [0 if not bounds else bisect_right(bounds, (h, k, t)) for h, k, t in zip(has_id, key, tie)]
        # a bound is the last row of its part: it belongs to the part it ends
        return pd.Series([a - 1 if a and bounds[a - 1] == x else a for a, x in zip(at, zip(has_id, key, tie))], dtype="int32")

    n = max(1, len(bounds))
    named = docs.select(F.col(id_col).isNotNull().alias("has_id"), _order_key(docs, id_col).alias("key"), F.xxhash64(text).alias("tie"), F.col(id_col).alias("id"), text.alias("t"))
    rows = named.withColumn("part", part_of(*order))
    last = spark.createDataFrame(bounds, f"has_id boolean, key {kind}, tie long").withColumn("ends", F.lit(True))
    rows = rows.join(F.broadcast(last), order, "left")  # a row for each part
    places = F.when(F.col("ends"), F.array(F.struct("part", F.lit(False).alias("lead")), F.struct(F.pmod(F.col("part") + 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("lead")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("lead")))
    )
    rows = rows.withColumn("at", F.explode(places)).select("at.part", F.when(F.col("at.lead"), 0).otherwise(1).alias("own"), *order, "id", "t")
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "own", *order)


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, tasks: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, kept_in_edited) of every row.

    The next document is the one with the next smaller id; after the smallest comes the largest. The edited text has the
    second half of the text replaced by as many of the next document's first code points. near_edited and near_next
    are estimated resemblances, kept_in_edited the containment in the edited text, n_shingles the estimated
    number of different shingles. Null texts are empty, rows of the same id follow each other by a hash of the text,
    null ids come last; ids that aren't whole numbers are ordered as strings. A single document follows itself. Other
    columns don't matter; no rows give no rows. A task streams over its part and holds two documents.
    """
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "kept_in_edited"]
    types = f"id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_in_edited double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = None, None
        for b in batches:
            own, out = [], []
            for i, (p, mine, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(6))):
                t = t.as_py()
                if p != part:
                    part, before = p, None
                if not mine:
                    if before is None:
                        before = (t, sketch(t, k, words))
                    continue
                s = sketch(t, k, words)
                following, near = before
                half = len(t) // 2
                edited = t[: len(t) - half] + following[:half]
                e = sketch(edited, k, words)
                own.append(i)
                out.append((
                    len(t), hashlib.sha256(edited.encode()).hexdigest(), to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, near, k), distinct_count(s, k), containment(s, e, k),
                ))
                before = (t, s)
            got = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(own, pa.int64())), *(pa.array(c, x) for c, x in zip(got, kinds))], names=columns)

    rows = neighbours(docs, id_col, text_col, tasks)
    return rows.mapInArrow(run, types).withColumnRenamed("id", id_col)
