"""Near-duplicate vectors by sorted passes of random projections: neighbours in lexicographic order are compared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import connected_components, discard, few_or_shuffled, saved


def prefix_bits(n: int, window: int, most: int) -> int:
    """Leading bits of a pass's key that about a quarter of a window of evenly spread vectors share: a window then holds nearly every such run whole."""
    return min(most, max(1, math.ceil(math.log2(max(2.0, 4 * n / window)))))


def passes_for(bits: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has shared no prefix of ``bits`` with probability ``miss`` at most.

    Two vectors agree in a hash bit with probability 1 - angle/pi, whatever lies around them.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


def _unit(vectors: pd.Series, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype("f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: str):
    """Whether a vector can be compared: neither null nor zero, with finite components only."""
    c = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(c.isNotNull() & F.forall(c, fine) & F.exists(c, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rep, least, copies, vector, dim) of every different usable vector, to be stored: rep is a number of its own, least its smallest id."""
    return (
        vectors.where(usable(vector_col))
        .groupBy(F.col(vector_col).alias("vector"))
        .agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("rep"), "least", "copies", "vector", F.size("vector").alias("dim"))
    )


def _hash_rows(passes: range, kind: str, bits: int, seed: int):
    """(dim, pass, key, rep): the hash bits of some passes for every vector, the first hash in the highest bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        place = 1 << np.arange(bits - 1, -1, -1, dtype="i8")
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = np.stack(part["vector"].to_list()).astype(kind).astype("f8")
                for p in passes:
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([seed, dim, p]).standard_normal((dim, bits))
                    yield pd.DataFrame({"dim": dim, "pass": p, "key": ((x @ planes[dim, p]) > 0) @ place, "rep": part["rep"].array})

    return run


def _numbered(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys in their lexicographic order with rank, the table stored for it): Spark sorts ranges; counts of the ranges, one for each task, give their first ranks."""
    order = ["dim", "pass", "key", "rep"]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = saved(ordered.select(*order, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "order")
    sizes, first, starts = stored.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect(), 0, []
    for r in sizes:
        starts.append((r["range"], first))
        first += r.n
    offsets = keys.sparkSession.createDataFrame(starts, "range int, first long")
    return stored.join(F.broadcast(offsets), "range").select(*order, (F.col("first") + F.col("at")).alias("rank")), stored  # a row for each range


def window_links(threshold: float, kind: str, window: int):
    """(src, dst): links that join what all links join between vectors at most ``window`` places apart in a pass's order.

    Rows (block, rank, dim, pass, rep, v) are sorted by block and rank; a block begins with the last ``window`` rows of the one before.
    """
    ahead = np.arange(2 * window)[None, :] - np.arange(window)[:, None]
    band = (ahead > 0) & (ahead <= window)

    def links(part: pd.DataFrame) -> pd.DataFrame:
        reps, x, n = part["rep"].to_numpy(), _unit(part["v"], kind), len(part)
        pairs = []
        for a in range(0, n, window):
            one, two = x[a : a + window], x[a : a + 2 * window]
            i, j = np.nonzero((one @ two.T >= threshold) & band[: len(one), : len(two)])
            pairs.append((a + i, a + j))
        i, j = (np.concatenate(c) for c in zip(*pairs))
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, j, label[i])
            np.minimum.at(new, i, label[j])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(n)
        return pd.DataFrame({"src": reps[moved], "dst": reps[label[moved]]})

    def block_links(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in block.groupby(["dim", "pass"], sort=False):
            yield links(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            at = b["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
            out = [x for s, e in zip(cuts, cuts[1:]) for x in block_links(b.iloc[s:e])]
            if out:
                yield pd.concat(out)
            held = b.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield from block_links(held)

    return run


def bucket_links(threshold: float, kind: str):
    """(src, dst): links that join what all links among the vectors of a run too long for a window, or of a pair of its blocks, join.

    Rows (dim, pass, prefix, lo, hi, own, rep, v) are sorted by the first five columns.
    """

    def links(part):
        reps, x = part["rep"].to_numpy(), _unit(part["v"], kind)
        a = z = slice(None)
        if part["lo"].iat[0] != part["hi"].iat[0]:
            a = part["own"].to_numpy() == part["lo"].iat[0]
            z = ~a
        near = x[a] @ x[z].T >= threshold
        left, right = reps[a], reps[z]
        if a is not z:
            i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        else:
            i = j = np.flatnonzero(near.sum(1) > near.diagonal())
        near, left, right = near[np.ix_(i, j)], left[i], right[j]
        if not near.size:
            return []
        # both sides take the smallest label that a link leads to, until all linked ones agree
        label, none = np.arange(len(left), dtype="i4"), np.int32(len(left))
        while True:
            other = np.where(near, label[:, None], none).min(0)
            new = np.minimum(label, np.where(near, other[None, :], none).min(1))
            if (new == label).all():
                break
            label = new
        src, dst = np.concatenate([left, right[other < none]]), left[np.concatenate([label, other[other < none]])]
        return [pd.DataFrame({"src": src, "dst": dst})[src != dst]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            at = b[["dim", "pass", "prefix", "lo", "hi"]].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()]
            out = [x for s, e in zip(cuts, cuts[1:]) for x in links(b.iloc[s:e])]
            if out:
                yield pd.concat(out)
            held = b.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield from links(held)

    return run


def _block_counts(threshold: float, kind: str):
    """(rep, n): for the vectors of each pair of blocks, how many vectors of the other block they link with."""

    def count(rows):
        (lo, hi), reps, blocks = rows[0][1:3], [r[3] for r in rows], np.array([r[4] for r in rows])
        copies, x = np.array([r[5] for r in rows]), _unit(pd.Series([r[6] for r in rows]), kind)
        near = (x @ x.T >= threshold).astype("f8")
        np.fill_diagonal(near, 0)
        if lo != hi:
            near *= blocks[:, None] != blocks[None, :]
        return list(zip(reps, (near @ copies).astype("i8").tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if group and row[:3] != group[0][:3]:
                    out += count(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=["rep", "n"])
        if group:
            yield pd.DataFrame(count(group), columns=["rep", "n"])

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    window: int = 128,
    miss: float = 1e-4,
    bits: int = 48,
    block: int = 1024,
    rows_per_task: int = 8192,
    passes_per_job: int = 8,
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are one representative with a number of copies, so copies cost nothing
    further. Each pass orders the representatives lexicographically by ``bits`` concatenated random hashes (signs of
    projections), and each is compared with the ``window`` next ones. A run of equal prefixes that is longer than a window, as a dense
    region makes it, is also compared in all pairs, in pairs of blocks of about ``block`` vectors. So every pair that
    shares a prefix in some pass is compared, however the vectors lie; prefixes are as long as ``prefix_bits`` says, and the number of passes makes a
    pair just at the threshold share none with probability ``miss``. Only (rep, hashes) are sorted; vectors are
    sent to the windows and blocks that need them, ``rows_per_task`` to each. Links of all
    passes are united. Inside the components all pairs are then counted exactly, in pairs of blocks too, however
    large a component is. Vectors that are null, zero or hold null or non-finite
    components, and vectors of different lengths, link with nothing, not even copies of
    themselves. Ids may be of any ordered type and repeat: every row counts as a vector of
    its own, and rows that share an id and nothing else aren't linked. A null id is never the smallest
    one; a component of these only has a null component_id and keeps nothing.
    """
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    reps = saved(distinct_vectors(vectors, id_col, vector_col), "vectors")
    short = prefix_bits(reps.count(), window, bits)
    passes = passes_for(short, threshold, miss)
    key_type = "long"
    run = ["dim", "pass", "prefix"]
    order = [*run, "lo", "hi"]
    to_bytes = lambda batches: (b.assign(v=[np.asarray(v, kind).tobytes() for v in b["v"]]) for b in batches)
    bytes_of = saved(reps.select("rep", F.col("vector").alias("v")).mapInPandas(to_bytes, f"rep {key_type}, v binary"), "bytes")
    found = []
    for a in range(0, passes, passes_per_job):
        some = range(a, min(passes, a + passes_per_job))
        keys = reps.select("dim", "rep", "vector").mapInPandas(_hash_rows(some, kind, bits, seed), f"dim int, pass int, key long, rep {key_type}")
        ranked, sorted_keys = _numbered(keys)
        ranked = ranked.withColumn("prefix", F.shiftright("key", bits - short))
        long_runs = saved(ranked.groupBy(*run).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where(F.col("n") > window).drop("n"), "runs")
        # where a vector goes in each pass: its block of the order, the next one if it stands in its last window, and its blocks of a long run
        place = F.col("rank") % rows_per_task >= rows_per_task - window
        home = (F.col("rank") / rows_per_task).cast("long")
        windows = ranked.select("rep", "dim", "pass", "rank", F.explode(F.when(place, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"))
        near = windows.join(bytes_of, "rep").select("block", "rank", "dim", "pass", "rep", "v").repartition("block").sortWithinPartitions("block", "rank")
        found.append(saved(near.mapInPandas(window_links(threshold, kind, window), f"src {key_type}, dst {key_type}").distinct(), "links"))
        dense = ranked.join(few_or_shuffled(long_runs), run).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dense = dense.select(*run, "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dense = dense.select(*run, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep").join(bytes_of, "rep").select(*order, "own", "rep", "v")
        near = dense.repartition(*order).sortWithinPartitions(*order).mapInPandas(bucket_links(threshold, kind), f"src {key_type}, dst {key_type}")
        found.append(saved(near.distinct(), "links"))
        for t in (long_runs, sorted_keys):
            discard(t)
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    components = connected_components(edges)
    sizes = components.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = (
        components.join(sizes, "component")
        .join(reps.withColumnRenamed("rep", "id"), "id")
        .select("component", "id", "copies", "vector", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    )
    pairs = (
        own.select("component", "id", "copies", F.col("vector").alias("v"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("id").alias("rep"), "own", "copies", "v")
        .repartition("component", "lo", "hi")
        .sortWithinPartitions("component", "lo", "hi")
        .mapInPandas(to_bytes, f"component {key_type}, lo int, hi int, rep {key_type}, own int, copies long, v binary")
    )
    linked = pairs.mapInPandas(_block_counts(threshold, kind), f"rep {key_type}, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    known = components.withColumnRenamed("id", "rep")
    named = saved(known.join(reps.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id")), "named")
    facts = reps.select("rep", "vector", "least", "copies").join(linked, "rep", "left").join(known, "rep", "left").join(named, "component", "left").select(
        F.col("vector").alias(vector_col), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    facts = saved(facts, "facts")
    for t in (*found, bytes_of, reps, components, named):
        discard(t)
    src = vectors.select(id_col, vector_col)
    alone = src.where(~usable(vector_col)).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return (
        src.where(usable(vector_col)).join(facts, vector_col).select(id_col, "n_links", "component_id").unionByName(alone)
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
