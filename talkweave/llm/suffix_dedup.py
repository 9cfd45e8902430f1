"""Removal of long repeated strings by external induced suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talkweave.llm.common import discard, few_or_shuffled, saved
from talkweave.llm.suffix_anchors import GRAM, anchor_place, anchored_runs
from talkweave.llm.suffix_sort import repeated

_T = ["t1", "t2"]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """With a 128-bit key of the text, a null one being empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(t), "t2": F.xxhash64(t, F.lit(1))})


def runs(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(t1, t2, se, a, c): the runs of windows of each text with a common anchor.

    se: first and last window, in one number. a: the anchor's hash. c: the hash of all bytes
    of the run's windows. Two windows can be equal only under the same anchor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t1, t2, text in b.itertuples(index=False, name=None):
                raw = text.encode()
                first, last, a = anchored_runs(np.frombuffer(raw, "u1"), length)
                view = memoryview(raw)
                c = np.array([xxhash.xxh3_64_intdigest(view[i : j + length], 7) for i, j in zip(first.tolist(), last.tolist())], "u8")
                out.append(pd.DataFrame({"t1": t1, "t2": t2, "se": first << 32 | last, "a": a.view("i8"), "c": c.view("i8")}))
                if sum(map(len, out)) > 100_000:
                    yield pd.concat(out)
                    out = []
            if out:
                yield pd.concat(out)

    src = _keyed(docs.where(F.octet_length(text_col) >= length).select(text_col), text_col).select(*_T, text_col)
    return src.mapInPandas(run, "t1 long, t2 long, se long, a long, c long")


def _sort_shards(length: int, shard_bytes: int):
    """(t1, t2, s, e): the repeated windows of rows sorted by anchor; a shard is as many anchors as come to ``shard_bytes``."""

    def shard(rows):
        out = []
        for (_, t1, t2, s, _, n, _), hit in zip(rows, repeated([r[6] for r in rows], [len(r[6]) - length + 1 for r in rows], length)):
            if n > 1:
                continue  # all windows of a run that occurs twice are known to
            edge = np.diff(np.concatenate([[0], hit.view("i1"), [0]]))
            out += [(t1, t2, s + a, s + z - 1) for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
        return pd.DataFrame(out, columns=[*_T, "s", "e"], dtype="i8")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, n = [], 0
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if n > shard_bytes and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, n = [], 0
                rows.append(row)
                n += len(row[6])
        if rows:
            yield shard(rows)

    return run


def _divided(length: int, span: int):
    """(g, c, t1, t2, s, e, n, p, raw): the windows of each snippet by the place of the anchor in them, ``span`` places together.

    g: the hash of the anchor's group, of these places and of the bytes that all windows with the anchor at
    one of them hold, so that equal windows have equal g. c: the hash of all bytes of the part's windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, t1, t2, s, e, n, p, raw in b.itertuples(index=False, name=None):
                at = (anchor_place(raw, length) if p < 0 else p - s) + s
                for lo in range((at - e) // span * span, at - s + 1, span):
                    hi = min(lo + span - 1, length - GRAM)
                    first, last = max(s, at - hi), min(e, at - lo)
                    core = raw[at - lo - s : at - hi + length - s]
                    part = raw[first - s : last - s + length]
                    key = b"%d %d %d " % (g, span, lo)
                    content = b"%d " % (at - first)
                    out.append((xxhash.xxh3_64_intdigest(key + core, 7), xxhash.xxh3_64_intdigest(content + part, 7), t1, t2, first, last, n, at, part))
                if len(out) > 10_000:
                    yield _parts(out)
                    out = []
            if out:
                yield _parts(out)

    return run


def _parts(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["g", "c", *_T, "s", "e", "n", "p", "raw"])
    return df.assign(g=df["g"].to_numpy("u8").view("i8"), c=df["c"].to_numpy("u8").view("i8"))


def divide(snippets: DataFrame, length: int, shard_bytes: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(ranges of repeated windows, snippets to sort, the tables that hold these) of the snippets of anchors that have more than ``shard_bytes``.

    The windows of an anchor are divided by the anchor's place in them, ever more finely, and by the
    bytes that all windows with it there hold. What shares these bytes with nothing is done, and
    so is what has the same windows as another. Groups that fit are sorted; at single
    places the shared bytes are the whole window, so no group is left.
    """
    found, small, stored = [], [], []
    for span in _spans(length - GRAM + 1):
        parts = saved(snippets.mapInPandas(_divided(length, span), "g long, c long, t1 long, t2 long, s long, e long, n long, p long, raw binary"), "parts")
        contents = parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct(*_T, "s", "e", "p", "raw")).alias("one"))
        contents = saved(contents, "contents")
        twice = contents.where("n > 1").select("g", "c")
        # what stands for several copies is known to be repeated already
        found.append(saved(parts.where("n = 1").join(twice, ["g", "c"], "left_semi").select(*_T, "s", "e"), "repeats"))
        groups = contents.groupBy("g").agg(F.count("*").alias("k"), F.sum(F.octet_length("one.raw")).alias("size")).where("k > 1").select("g", "size")
        rest = saved(contents.join(groups, "g").select(F.col("g").alias("a"), "one.t1", "one.t2", "one.s", "one.e", "n", "one.p", "one.raw", "size"), "snippets")
        discard(parts)
        discard(contents)
        stored.append(rest)
        small.append(rest.where(F.col("size") <= shard_bytes).drop("size", "p"))
        snippets = rest.where(F.col("size") > shard_bytes).drop("size")
        if snippets.isEmpty():
            break
    return found, small, stored


def _spans(places: int) -> list[int]:
    out = [places]
    while out[-1] > 1:
        out.append(-(-out[-1] // 8))
    return out[1:] or [1]


def repeated_windows(docs: DataFrame, text_col: str = "text", length: int = 400, shard_bytes: int = 1 << 20) -> DataFrame:
    """(t1, t2, s, e), saved, by text key: ranges of first bytes of the strings that also begin elsewhere.

    Equal strings have equal content-chosen anchors, so only runs of windows whose anchor
    occurs twice are looked at further. A run whose whole content occurs twice is repeated,
    and stands once for all its copies in what follows, however many they are. The
    different contents of an anchor come together in one shard, where induced sorting
    orders their suffixes and finds those that share ``length`` bytes with a neighbour. An
    anchor with more than ``shard_bytes`` of contents is divided first, so that no shard
    holds more than twice as much, but for a single run.
    """
    all_runs = saved(runs(docs, text_col, length), "runs")
    anchors = saved(all_runs.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").drop("n"), "anchors")
    # a stored side on each side of the join: a very common anchor's rows can be split
    shared = saved(all_runs.join(anchors, "a"), "shared")
    for t in (all_runs, anchors):
        discard(t)
    contents = saved(
        shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("t1", "t2", "se")).alias("one")), "contents"
    )
    first_byte, last_byte = F.shiftright("se", 32), F.col("se").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = shared.join(contents.where("n > 1").select("a", "c"), ["a", "c"]).select(*_T, "se").distinct().select(*_T, first_byte.alias("s"), last_byte.alias("e"))
    whole = saved(whole, "whole")
    discard(shared)
    part = contents.where("mixed").select("a", "n", "one.*")
    over = saved(part.groupBy("a").agg(F.sum(last_byte - first_byte + length).alias("size")).where(F.col("size") > shard_bytes).select("a"), "over")
    part = part.join(few_or_shuffled(over.withColumn("crowded", F.lit(True))), "a", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    places = part.groupBy(*_T).agg(F.collect_list(F.struct("a", "n", "se", "crowded")).alias("places"))
    long = docs.where(F.octet_length(text_col) >= length).select(F.col(text_col).alias("t"))
    once = _keyed(long, "t").groupBy(*_T).agg(F.first("t").alias("t")).join(places, _T)  # copies of a text meet before they move
    snippets = once.select(*_T, F.col("t").cast("binary").alias("raw"), F.explode("places").alias("p")).select("p.*", *_T, "raw")
    snippets = snippets.select("a", "crowded", *_T, first_byte.alias("s"), last_byte.alias("e"), "n", F.expr(f"substring(raw, int(se >> 32) + 1, int((se & {0xFFFFFFFF}L) - (se >> 32)) + {length})").alias("raw"))
    divided, found = [], [whole]
    if not over.isEmpty():
        large = saved(snippets.where("crowded").select("a", *_T, "s", "e", "n", F.lit(-1).cast("long").alias("p"), "raw"), "crowded")
        divided, small, stored = divide(large, length, shard_bytes)
        snippets = snippets.where(~F.col("crowded"))
        found += divided
        for t in small:
            snippets = snippets.unionByName(t.withColumn("crowded", F.lit(True)))
        divided += [large, *stored]
    snippets = snippets.select("a", *_T, "s", "e", "n", "raw")
    found.append(snippets.repartition("a").sortWithinPartitions("a").mapInPandas(_sort_shards(length, shard_bytes), "t1 long, t2 long, s long, e long"))
    ranges = found[0]
    for t in found[1:]:
        ranges = ranges.unionByName(t)
    out = saved(ranges, "repeats")
    for t in (whole, contents, over, *divided):
        discard(t)
    return out


def merged(starts: np.ndarray, lasts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.maximum.accumulate(lasts[order]) + length
    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
    return list(zip(a[new].tolist(), z[np.append(new[1:], len(a)) - 1].tolist()))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with n_bytes, spans (start, end of each removed run), kept (the remaining bytes) and
    kept_text (these as text, without characters that were cut through).

    A byte goes if a string of ``length`` bytes over it begins anywhere else too, in the same or
    another row; strings are judged on the input. All copies of a repeated string go. Null
    and empty texts have zero bytes. Rows are kept as they are, whatever their ids.
    """
    windows = repeated_windows(docs, text_col, length)
    spans_of = saved(windows.groupBy(*_T).agg(F.collect_list(F.struct("s", "e")).alias("w")), "spans")
    discard(windows)

    @pandas_udf("spans array<struct<start:long,end:long>>, kept binary, kept_text string")
    def cut(texts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for t, w in zip(texts, windows):
            raw, at, parts = t.encode(), 0, []
            got = merged(*np.array([(x["s"], x["e"]) for x in w], "i8").T, length) if w is not None and len(w) else []
            for a, z in got:
                parts.append(raw[at:a])
                at = z
            parts.append(raw[at:])
            spans.append([{"start": a, "end": z} for a, z in got])
            kept.append(b"".join(parts))
        return pd.DataFrame({"spans": spans, "kept": kept, "kept_text": [k.decode("utf-8", "ignore") for k in kept]})

    out = _keyed(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("t")), "t").join(spans_of.hint("shuffle_hash"), _T, "left")
    out = out.select("row", F.coalesce("t", F.lit("")).alias("t"), "w").withColumn("cut", cut("t", "w"))
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns), F.octet_length("t").cast("long").alias("n_bytes"), "cut.spans", "cut.kept", "cut.kept_text"
    )
