"""Fuzzy line dedup by MinHash, in DataFrame operations alone."""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import connected_components, discard, document_keys, few_or_shuffled, saved

_NONE = (1 << 63) - 1
#: Shingles that one row of the signature's aggregate takes at once.
_CHUNK = 8
#: What tells a document: its id and a 128-bit hash of it and its text.
_DOC = ["id", "r1", "r2"]
_LINE = ["k1", "k2"]
#: 64-bit words of the bitmap of a line's shingles.
_WORDS = 16
#: A line's set and its bitmap.
_SET = ["s", *(f"w{w}" for w in range(_WORDS))]


def normalized(line: Column) -> Column:
    """Lines are compared in lower case, without spaces at the ends."""
    return F.lower(F.trim(line))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r1, r2, pos, line, k1, k2): the lines that aren't blank, normalised, with 128 bits of hash."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = own.select("id", *document_keys(F.col("id"), F.col("text")), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    plain = split.select(*_DOC, "pos", normalized(F.col("line")).alias("line")).where("line <> ''")
    return plain.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def band_bins(bins: int, bands: int, seed: int = 17) -> list[tuple[int, ...]]:
    """The three bins of each band: every bin about as often, and two bins together at most once while that can be."""
    r, out, used, together = random.Random(seed), [], [0] * bins, set()
    for _ in range(bands):
        tries = [tuple(sorted(r.sample(range(bins), 3))) for _ in range(200)]
        pairs = lambda t: {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])}
        best = min(tries, key=lambda t: (len(pairs(t) & together), sum(used[b] for b in t)))
        out.append(best)
        together |= pairs(best)
        for b in best:
            used[b] += 1
    return out


def hashed_chunks(rows: DataFrame, width: int, chunk: int = _CHUNK) -> DataFrame:
    """(k1, k2, c, h0, h1, ...): the hashes of ``chunk`` shingles a row; rows: (k1, k2, line).

    A shingle is ``width`` UTF-16 units from any place, or the whole of a shorter line. Past the last one, the hash is the largest.
    """
    u = rows.select(*_LINE, F.encode("line", "UTF-16BE").alias("u"))
    u = u.withColumn("n", F.expr(f"greatest(1, octet_length(u) div 2 - {width - 1})"))
    c = u.withColumn("c", F.explode(F.expr(f"sequence(0, (n - 1) div {chunk})")))
    c = c.select(*_LINE, "c", F.expr(f"substring(u, {2 * chunk} * c + 1, {2 * (chunk + width - 1)})").alias("s"), F.expr(f"n - {chunk} * c").alias("left"))
    h = [F.expr(f"if({q} < left, xxhash64(substring(s, {2 * q + 1}, {2 * width})), {_NONE}L)").alias(f"h{q}") for q in range(chunk)]
    return c.select(*_LINE, "c", *h)


def signatures(rows: DataFrame, width: int, bins: int, bands: int, seed: int = 17) -> DataFrame:
    """(k1, k2, n, b0, b1, ...): for each different line how often it occurs, and its bucket in each band; rows: (k1, k2, line).

    A one-permutation MinHash: every shingle is hashed once, and the least hash of each of
    ``bins`` classes of hashes makes the signature. A class without a hash takes that of
    another one, in an order of its own.
    """
    c = hashed_chunks(rows, width)
    c = c.select(
        *_LINE, "c",
        *(F.expr(f"cast((h{q} & 65535L) % {bins} as int)").alias(f"j{q}") for q in range(_CHUNK)),
        *(F.expr(f"shiftrightunsigned(h{q}, 16)").alias(f"v{q}") for q in range(_CHUNK)),
    )
    none = _NONE >> 16  # of the places past a line's end
    least = [F.min(F.least(*(F.expr(f"if(j{q} = {j}, v{q}, {none}L)") for q in range(_CHUNK)))).alias(f"m{j}") for j in range(bins)]
    found = c.groupBy(*_LINE).agg(F.sum(F.expr("if(c = 0, 1L, 0L)")).alias("n"), *least)
    r, filled = random.Random(seed), []
    for j in range(bins):
        order = [j, *r.sample([x for x in range(bins) if x != j], bins - 1)]
        filled.append(F.coalesce(*(F.expr(f"nullif(m{x}, {none}L)") for x in order)).alias(f"m{j}"))
    found = found.select(*_LINE, "n", *filled)
    return found.select(*_LINE, "n", *(F.xxhash64(F.lit(i), *(f"m{j}" for j in b)).alias(f"b{i}") for i, b in enumerate(band_bins(bins, bands, seed))))


def shingle_sets(rows: DataFrame, width: int, chunk: int = 2 * _CHUNK) -> DataFrame:
    """(k, s): the set of a line's shingles, as 32-bit hashes, of different lines (k1, k2, line)."""
    none = _NONE >> 32
    part = F.filter(F.array(*(F.expr(f"cast(shiftright(h{q}, 32) as int)") for q in range(chunk))), lambda h: h != none)
    every = F.array(*(F.expr(f"cast(shiftright(h{q}, 32) as int)") for q in range(chunk)))
    part = F.when(F.col(f"h{chunk - 1}") == _NONE, part).otherwise(every)
    return hashed_chunks(rows, width, chunk).groupBy(*_LINE).agg(F.array_distinct(F.flatten(F.collect_list(part))).alias("s")).select(F.struct(*_LINE).alias("k"), "s")


def jaccard_holds(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets' Jaccard similarity is at least ``similarity``; unlike sizes are seen first."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    # so many common ones are needed; less what rounding may add
    need = F.ceil((F.size(a) + F.size(b)) * (similarity / (1 + similarity)) - 1e-9)
    return (small >= similarity * large) & (F.size(F.array_intersect(a, b)) >= need)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of the pairs of lines that are similar; sets: (k, s)."""
    a, b = (sets.select(F.col("k").alias(k), F.col("s").alias(s)) for k, s in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").where(jaccard_holds(F.col("a"), F.col("b"), similarity)).select("src", "dst")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(k, w0, w1, ...): which of 1,024 remainders a set's hashes leave."""
    h = sets.select("k", F.explode("s").alias("h"))
    bit = "shiftleft(1L, h & 63)"
    return h.groupBy("k").agg(*(F.bit_or(F.expr(f"if((h >> 6) & {_WORDS - 1} = {w}, {bit}, 0L)")).alias(f"w{w}") for w in range(_WORDS)))


def apart_lines(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, s, bands, items, w0, ...), saved: the lines of ``rest`` with their sets, all their buckets there, their sets' sizes and bitmaps."""
    every = rest.groupBy("k").agg(F.collect_set("band").alias("bands"))
    own = saved(sets.join(every, "k").withColumn("items", F.size("s")), "own")
    mine = saved(own.join(bitmaps(own), "k"), "mine")
    discard(own)
    return mine


def may_hold(similarity: float) -> Column:
    """Whether the bitmaps of two sets leave it open that these are similar: a set has at least as many items that the other one lacks as bits."""
    lacks = lambda a, b: sum((F.bit_count(F.col(f"w{w}{a}").bitwiseAND(F.bitwise_not(F.col(f"w{w}{b}")))) for w in range(_WORDS)), F.lit(0))
    need = F.ceil((F.size("s") + F.size("s_2")) * (similarity / (1 + similarity)) - 1e-9)
    # of sets of unlike sizes no bits are counted
    return (F.least(F.size("s"), F.size("s_2")) >= need) & (F.size("s") - lacks("", "_2") >= need) & (F.size("s_2") - lacks("_2", "") >= need)


def still_apart(apart: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components; two members, of which one is the center, were compared before."""
    mixed = apart.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("n")).where("a <> z and n > 2").select("band")
    return apart.join(mixed, "band")


def large_buckets(rest: DataFrame, least: int) -> DataFrame:
    """(band, k, component, n), saved: the rows of the buckets of more than ``least`` lines, with how many."""
    sizes = rest.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return saved(rest.join(sizes, "band").select("band", "k", "component", "n"), "large")


def drawn_links(large: DataFrame, label: DataFrame, mine: DataFrame, similarity: float, turn: int, block_lines: int = 1024) -> DataFrame:
    """(src, dst, pairs), saved: components that lines drawn from each bucket join; large: (band, k, n), label: (k, component), turn: which draw.

    Two lines of a bucket are drawn and all others compared with them. ``pairs`` adds up to
    the number of similar pairs of different components that the buckets are to be expected to hold.
    """
    blocks = F.ceil(F.col("n") / block_lines).cast("int")
    draw = lambda i: F.min(F.struct(F.xxhash64("band", "k", F.lit(2 * turn + i)).alias("h"), "k"))
    both = large.groupBy("band", blocks.alias("blocks")).agg(draw(0).alias("p"), draw(1).alias("q"))
    drawn = both.select("band", "blocks", F.explode(F.array_distinct(F.array("p.k", "q.k"))).alias("k"))
    drawn = drawn.select("band", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")).join(label, "k").join(mine, "k")
    dealt = large.select("band", "n", "k", F.pmod(F.xxhash64("k"), blocks).cast("int").alias("own")).join(label, "k").join(mine, "k")
    right = drawn.select("band", "own", *(F.col(c).alias(f"{c}_2") for c in ("component", *_SET)))
    met = dealt.join(right, ["band", "own"]).where((F.col("component") != F.col("component_2")) & may_hold(similarity) & jaccard_holds(F.col("s"), F.col("s_2"), similarity))
    met = met.select(F.greatest("component", "component_2").alias("src"), F.least("component", "component_2").alias("dst"), (F.col("n") / 4).alias("pairs"))
    return saved(met.groupBy("src", "dst").agg(F.sum("pairs").alias("pairs")), "links")


def relabelled(rows: DataFrame, joined: DataFrame, name: str) -> DataFrame:
    """``rows``, saved, with the component that theirs is in now; joined: ``connected_components`` of components."""
    top = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    now = F.coalesce("top", "component").alias("component")
    return saved(rows.join(top, "component", "left").select(*(now if c == "component" else c for c in rows.columns)), name)


def draw_together(rest: DataFrame, mine: DataFrame, similarity: float, least: int = 128, block_lines: int = 1024) -> tuple[DataFrame, list[DataFrame]]:
    """``rest``, saved, with fewer components, and the links that joined them; deletes ``rest``.

    Draws go on while more similar pairs across components are to be expected than there are
    rows, so that what is left to compare all pairs for gives rows in proportion to the input.
    Every such draw joins some components. A draw relabels the lines of large buckets, one row
    each; the rows of all buckets are relabelled once, at the end.
    """
    large = large_buckets(rest, least)
    first = saved(large.select("k", "component").distinct(), "labels")
    label, rows, links, joined = first, rest.count(), [], None
    while not large.isEmpty():
        found = drawn_links(large, label, mine, similarity, len(links), block_lines)
        if (found.agg(F.sum("pairs")).first()[0] or 0) <= rows:
            discard(found)
            break
        links.append(found)
        for t in (joined, label if label is not first else None):
            if t is not None:
                discard(t)
        joined = connected_components(functools.reduce(DataFrame.unionByName, links))
        label = relabelled(first, joined, "labels")
    if joined is not None:
        now = relabelled(rest, joined, "relabelled")
        for t in (rest, joined, label):
            discard(t)
        rest = saved(still_apart(now), "mixed")
        discard(now)
    for t in (large, first):
        discard(t)
    return rest, links


def links_across(rest: DataFrame, mine: DataFrame, similarity: float, block_lines: int = 1024, block_items: int = 1 << 19) -> DataFrame:
    """(src, dst), saved: components that similar lines of a bucket join; rest: (band, k, component), mine: ``apart_lines``.

    A bucket's lines are dealt into blocks of about ``block_lines`` lines or ``block_items``
    shingles. Blocks meet in pairs, each pair under a key of its own, and of the lines of
    different components in them the similar ones are joined. Lines of a bucket's largest component
    needn't meet each other, so only the others are sought for. Two lines that share
    several buckets are compared in the one of the smallest number.
    """
    size = F.greatest(F.sum("n") / block_lines, F.sum("items") / block_items)
    parts = rest.join(mine.select("k", "items"), "k").groupBy("band", "component").agg(F.count("*").alias("n"), F.sum(F.col("items") + 1).alias("items"))
    blocks = saved(parts.groupBy("band").agg(F.ceil(size).cast("int").alias("blocks"), F.max(F.struct("n", "component")).alias("most")), "blocks")
    dealt = rest.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.col("component") != F.col("most.component"))
    every, held = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), ["component", "bands", *_SET]
    left = dealt.where("other").join(mine, "k").select("band", F.col("own").alias("lo"), every.alias("hi"), *held)
    right = dealt.join(mine, "k").select("band", every.alias("lo"), F.col("own").alias("hi"), "other", *(F.col(c).alias(f"{c}_2") for c in held))
    near = (
        (~F.col("other") | (F.col("component") < F.col("component_2")))
        & may_hold(similarity)
        & (F.array_min(F.array_intersect("bands", "bands_2")) == F.col("band"))
        & jaccard_holds(F.col("s"), F.col("s_2"), similarity)
    )
    met = left.join(right, ["band", "lo", "hi"]).where(near)
    links = saved(met.select(F.greatest("component", "component_2").alias("src"), F.least("component", "component_2").alias("dst")).distinct(), "links")
    discard(blocks)
    return links


def members_of_buckets(signed: DataFrame) -> DataFrame:
    """(band, k), saved: the lines of each bucket that holds several; signed: ``signatures``."""
    banded = signed.select(*_LINE, F.explode(F.array(*(c for c in signed.columns if c.startswith("b")))).alias("band"))
    shared = saved(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    members = saved(banded.join(few_or_shuffled(shared), "band").select("band", F.struct(*_LINE).alias("k")), "members")
    discard(shared)
    return members


def similar_lines(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id, component), saved, of the lines that are similar to another one; members: (band, k), sets: (k, s), which it deletes.

    Lines in a common bucket are candidates. A bucket's members are first compared with
    its smallest one. Components of the pairs that hold leave few buckets in which
    members are still apart. Large ones of these are compared with lines drawn from them,
    until few similar pairs are apart; then all members of different components are compared, in
    pairs of blocks. No bucket is capped, and no pair of a bucket is left out.
    """
    centers = members.groupBy("band").agg(F.min("k").alias("center"))
    stars = members.join(centers, "band").where("k <> center").select(F.col("k").alias("src"), F.col("center").alias("dst")).distinct()
    first = saved(similar_pairs(stars, sets, similarity), "links")
    found = connected_components(first)
    apart = saved(members.join(found.withColumnRenamed("id", "k"), "k", "left").select("band", "k", F.coalesce("component", "k").alias("component")), "apart")
    rest = saved(still_apart(apart), "mixed")  # reads them twice
    discard(apart)
    mine = apart_lines(rest, sets)
    discard(sets)
    rest, drawn = draw_together(rest, mine, similarity)
    across = links_across(rest, mine, similarity)
    discard(mine)
    joined = connected_components(functools.reduce(DataFrame.unionByName, [t.select("src", "dst") for t in drawn], across))
    alone = joined.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    out = relabelled(found.unionByName(alone), joined, "components")
    for t in (first, found, rest, *drawn, across, joined):
        discard(t)
    return out


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, similarity: float = 0.8, bins: int = 12, bands: int = 10
) -> DataFrame:
    """(r1, r2, gone), saved: by document key, the positions of its lines that aren't the first of their component, in order of id and position."""
    rows = saved(lines(docs, id_col, text_col), "lines")
    signed = saved(signatures(rows, width, bins, bands), "signatures")
    members = members_of_buckets(signed)
    repeats = saved(signed.where("n > 1").select(*_LINE), "repeats")
    discard(signed)
    ids = saved(members.select("k.*").distinct(), "ids")
    sets = saved(shingle_sets(rows.join(few_or_shuffled(ids), _LINE).select(*_LINE, "line").dropDuplicates(_LINE), width), "sets")
    places = saved(rows.drop("line"), "places")
    for t in (rows, ids):
        discard(t)
    similar = similar_lines(members, sets, similarity)  # deletes the sets when they are no longer needed
    discard(members)
    marked = repeats.join(similar.select("id.*", "component"), _LINE, "full").select(*_LINE, F.coalesce("component", F.struct(*_LINE)).alias("component"))
    marked = saved(marked, "marked")
    found = saved(places.join(marked, _LINE).select("component", F.struct(*_DOC, "pos").alias("at")), "found")
    for t in (repeats, similar, places, marked):
        discard(t)
    kept = saved(found.groupBy("component").agg(F.min("at").alias("kept")), "kept")
    gone = found.join(kept, "component").where("at <> kept").groupBy("at.r1", "at.r2").agg(F.collect_set("at.pos").alias("gone"))
    gone = saved(gone, "gone")
    for t in (found, kept):
        discard(t)
    return gone


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every line that is similar to an earlier one taken out of its text.

    Lines are similar if the Jaccard similarity of their character shingles is at least
    ``similarity``, or linked through such lines; the line with the smallest id and
    position of each component stays. Blank lines and null texts stay as they are; a text
    all of whose lines go becomes empty. A document is known by its id and its text: rows
    that share an id but not the text are different ones (in the order of a hash), rows
    that share both are one document here and keep the same lines, and null ids come
    first. Other columns may have any name. No rows give no rows. Lines and documents are
    told apart by 128 bits of hash, shingles by 32.
    """
    gone = repeated_lines(docs, id_col, text_col, **how)
    text = F.col(text_col)
    own = docs.select(F.struct("*").alias("row"), text.alias("text"), *document_keys(F.col(id_col), text))
    out = own.join(gone.hint("shuffle_hash"), ["r1", "r2"], "left").withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    out = out.select("row", text.alias("text"))
    return out.select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
