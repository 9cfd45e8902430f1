"""Ordered segmentation: compactions, sections, turns, segments, file clusters and markdown outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators.durable import stored
from talkweave.operators.scan import BLOCK, blocked, by_length, ranged, scan


def mark_pre_compact(m: DataFrame) -> DataFrame:
    """is_pre_compact: strictly before the session's last boundary."""
    last = m.where("subtype = 'compact_boundary'").groupBy("S").agg(F.max("ord").alias("_last"))
    return m.join(last, "S", "left").withColumn("is_pre_compact", F.coalesce(F.col("ord") < F.col("_last"), F.lit(False))).drop("_last")


def sections(m: DataFrame, block: int = BLOCK) -> DataFrame:
    """user and assistant rows that the system didn't inject, with section_no from 0 within the rows kept.

    Needs is_boundary, system_generated and, where there is shared context, is_shared.
    Shared rows are a section of their own before the others; sections without rows vanish. Sessions of more than ``block`` rows
    are scanned in blocks (``scan``; ord is a whole number there), so that none of them is a single task.
    """
    return by_length(m, ("S",), block, _sections, lambda x: _long_sections(x, block))


def _part(m: DataFrame, boundaries: Column) -> Column:
    shared = F.coalesce("is_shared", F.lit(False)) if "is_shared" in m.columns else F.lit(False)
    return F.when(shared, F.lit(-1)).otherwise(boundaries).cast("long")


def _kept(at: DataFrame) -> DataFrame:
    return at.where(F.col("type").isin("user", "assistant") & ~F.col("system_generated") & ~F.col("is_boundary"))


def _sections(m: DataFrame) -> DataFrame:
    w = Window.partitionBy("S").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    at = m.withColumn("_part", _part(m, F.sum(F.col("is_boundary").cast("int")).over(w)))
    return _kept(at).withColumn("section_no", F.dense_rank().over(Window.partitionBy("S").orderBy("_part")) - 1)


def _long_sections(m: DataFrame, block: int) -> DataFrame:
    at = scan(blocked(m, size=block), ("S",), ("ord",), sums={"_n": F.col("is_boundary").cast("int")})
    kept = stored(_kept(at.withColumn("_part", _part(m, F.col("_n")))).select(*m.columns, "_part"), "sections")
    parts = kept.select("S", "_part").distinct()  # a row for each section
    number = parts.select("S", "_part", (F.row_number().over(Window.partitionBy("S").orderBy("_part")) - 1).alias("section_no"))
    return kept.join(number, ["S", "_part"]).select(*m.columns, "_part", "section_no")


def section_labels(sectioned: DataFrame, m: DataFrame) -> DataFrame:
    """(S, section_no, kind, n_users): shared, original, after-compaction with its number, or current."""
    total = m.groupBy("S").agg(F.sum(F.col("is_boundary").cast("int")).alias("n_boundaries"))
    got = sectioned.groupBy("S", "section_no", "_part").agg(F.count_if(F.col("type") == "user").alias("n_users")).join(total, "S")
    kind = (
        F.when(F.col("_part") == -1, "shared").when(F.col("_part") == F.col("n_boundaries"), "current")
        .when(F.col("_part") == 0, "original").otherwise(F.concat(F.lit("after-compaction "), F.col("_part")))
    )
    return got.select("S", "section_no", kind.alias("kind"), "n_users")


def turns(sectioned: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows with turn_no (0: assistants before any user row), starts_turn and turn_text, within (S, section_no).

    A kept user row starts a turn unless it is a command output and the user row that
    owns the turn so far is one too, or it holds only image paths after an earlier user row:
    these are merged, and turn_text of the row that starts the turn is the texts of all of its user rows.
    Assistants need a text or tools (n_tools). Sections of more than ``block`` rows are scanned in blocks.
    """
    user, assistant, text = F.col("type") == "user", F.col("type") == "assistant", F.col("text")
    skipped = F.coalesce(F.col("subtype").isin("task-notification", "skill-output", "system-reminder"), F.lit(False))
    tools = F.col("n_tools") if "n_tools" in sectioned.columns else F.lit(0)
    kept = sectioned.where(~skipped & ((user & (T.strip(text) != "")) | (assistant & ((T.strip(text) != "") | (tools > 0)))))
    return by_length(kept, ("S", "section_no"), block, _turns, lambda x: _long_turns(x, block))


def _turns(kept: DataFrame) -> DataFrame:
    user, text = F.col("type") == "user", F.col("text")
    before = Window.partitionBy("S", "section_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("S", "section_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    had_user = F.coalesce(F.max(user.cast("int")).over(before), F.lit(0)) == 1
    step = kept.withColumn("_image", user & T.strip(text).rlike(T.ONLY_IMAGE_PATHS) & had_user)
    command = F.coalesce(F.col("subtype"), F.lit("")) == "command-output"
    owner = F.last(F.when(user & ~F.col("_image"), command.cast("int")), ignorenulls=True).over(before)
    step = step.withColumn("starts_turn", user & ~F.col("_image") & ~(command & (F.coalesce(owner, F.lit(0)) == 1)))
    step = step.withColumn("turn_no", F.sum(F.col("starts_turn").cast("int")).over(upto)).drop("_image")
    whole = Window.partitionBy("S", "section_no", "turn_no").orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    said = F.array_join(F.collect_list(F.when(user, text)).over(whole), "\n")
    return step.withColumn("turn_text", F.when(F.col("starts_turn"), said))


def _long_turns(kept: DataFrame, block: int) -> DataFrame:
    user, text, columns = F.col("type") == "user", F.col("text"), kept.columns
    by = ("S", "section_no")
    kept = scan(stored(blocked(kept, size=block), "turns"), by, ("ord",), lasts={"_had": F.when(user, F.lit(1))})
    command = F.coalesce(F.col("subtype"), F.lit("")) == "command-output"
    step = kept.withColumn("_image", user & T.strip(text).rlike(T.ONLY_IMAGE_PATHS) & F.col("_had").isNotNull()).drop("_had")
    step = scan(stored(step, "turns"), by, ("ord",), lasts={"_owner": F.when(user & ~F.col("_image"), command.cast("int"))})
    step = step.withColumn("starts_turn", user & ~F.col("_image") & ~(command & (F.coalesce("_owner", F.lit(0)) == 1))).drop("_owner")
    step = stored(scan(stored(step, "turns"), by, ("ord",), sums={"turn_no": F.col("starts_turn").cast("int")}).drop("_image", "_block"), "turns")
    # a turn's user rows, its first one starting it
    said = step.where(user & (F.col("turn_no") > 0)).groupBy("S", "section_no", "turn_no").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_said"))
    said = said.select("S", "section_no", "ord", F.array_join(F.transform("_said", lambda x: x["text"]), "\n").alias("turn_text"))
    return step.join(said, ["S", "section_no", "ord"], "left").select(*columns, "starts_turn", "turn_no", "turn_text")


def segments(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(S, section_no, turn_no, segment_no, kind, first_ord, n_items); items: kind ``text`` or ``tool`` in order (ord, pos).

    A text is a segment of its own; tools that follow each other are one. Turns of more than ``block`` items are scanned in blocks.
    """
    step = by_length(items, ("S", "section_no", "turn_no"), block, _numbered_items, lambda x: _long_items(x, block))
    return step.groupBy("S", "section_no", "turn_no", "segment_no").agg(F.min("kind").alias("kind"), F.min("ord").alias("first_ord"), F.count("*").alias("n_items"))


def _numbered_items(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("S", "section_no", "turn_no").orderBy("ord", "pos")
    new = (F.col("kind") == "text") | F.coalesce(F.lag("kind").over(w) == "text", F.lit(True))
    step = items.withColumn("_new", new.cast("int")).withColumn("segment_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return step.drop("_new")


def _long_items(items: DataFrame, block: int) -> DataFrame:
    by, order = ("S", "section_no", "turn_no"), ("ord", "pos")
    step = scan(stored(blocked(items, size=block), "items"), by, order, lasts={"_before": F.col("kind")})
    step = stored(step.withColumn("_new", (F.col("kind") == "text") | F.coalesce(F.col("_before") == "text", F.lit(True))), "items")
    return scan(step, by, order, sums={"segment_no": F.col("_new").cast("int")}).select(*items.columns, "segment_no")


def segment_tool_counts(items: DataFrame) -> DataFrame:
    """(…, segment_no, tool, n), items with segment_no and tool."""
    return items.where("kind = 'tool'").groupBy("S", "section_no", "turn_no", "segment_no", "tool").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def transitions(rows: DataFrame, by: str = "branch") -> DataFrame:
    """(branch, n): changes of side in time order; rows: (branch, side 0 main or 1 branch, ts, pos). Rows without a time don't count."""
    w = Window.partitionBy(by).orderBy("ts", "side", "pos")
    moved = rows.where("ts is not null").withColumn("_was", F.lag("side").over(w))
    return moved.groupBy(by).agg(F.count_if(F.col("_was") != F.col("side")).alias("n"))


def continuation_clusters(ranges: DataFrame, tolerance_s: float = 1.0, most: int = BLOCK) -> DataFrame:
    """(S, file, start, end, cluster): files by start, each to the first cluster that ended before it, but for a tolerance.

    A fold over a session's sorted files, which stream through Python in Arrow batches; it holds the clusters' ends only,
    in a tree of minima that finds the first fitting one. Without times, a file is its own cluster. Sessions of more than ``most`` files
    are cut where all earlier files have ended, and their pieces are folded apart.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    files = ranges.select("S", "file", "start", "end", micros("start").alias("_start"), micros("end").alias("_end"), F.col("start").isNull().alias("_none"))
    tolerance = round(tolerance_s * 1e6)
    return by_length(files, ("S",), most, lambda x: _folded(x, tolerance), lambda x: _folded_in_pieces(x, tolerance))


_FILE_ORDER = ("_none", "start", "end", "file")


def _folded(files: DataFrame, tolerance: int) -> DataFrame:
    rows = files.repartition("S").sortWithinPartitions("S", *_FILE_ORDER).drop("_none")
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:4])
    return rows.mapInArrow(_cluster_files(tolerance), f"{types}, cluster int")


def _folded_in_pieces(files: DataFrame, tolerance: int) -> DataFrame:
    """At a file that begins after all earlier ones have ended, every cluster is free, as if there were none yet: pieces between such files are folded
    apart, with as many free clusters as they like. Afterwards these are numbered as the whole fold would: a cluster exists from its first file on. A file without
    an end takes a free cluster that exists, and else one of its own that nobody joins; such ones, and files without a start, shift the numbers after them."""
    by = ("S",)
    rows = ranged(files, by, _FILE_ORDER)
    ends = stored(scan(rows, by, _FILE_ORDER, maxes={"_before": F.when(~F.col("_none"), F.col("_end"))}), "ends")
    cut = F.coalesce(F.col("_start") + tolerance >= F.col("_before"), F.col("_before").isNull()).cast("int")
    pieces = scan(ends, by, _FILE_ORDER, sums={"piece": cut}).drop("_before")
    types = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    place = ["S", "piece", *_FILE_ORDER]
    folded = pieces.repartition("S", "piece").sortWithinPartitions(*place).mapInArrow(_piece_places(tolerance, pieces.columns), f"{types}, at int")
    folded = stored(folded, "folded")
    fills = ~F.col("_none") & F.col("_end").isNotNull()
    known = stored(scan(folded, by, _FILE_ORDER, maxes={"_high": F.when(fills, F.col("at"))}), "known")
    exist = F.coalesce(F.col("_high") + 1, F.lit(0))
    alone = F.col("_none") | (F.col("_end").isNull() & (F.col("at") >= exist))
    counted = stored(scan(known.withColumn("_alone", alone.cast("int")), by, _FILE_ORDER, sums={"_shift": F.col("_alone")}).withColumn("_shift", F.col("_shift") - F.col("_alone")), "counted")
    first = counted.where(fills).groupBy("S", "at").agg(F.min_by("_shift", F.struct(*_FILE_ORDER)).alias("_by"))
    out = counted.join(first, ["S", "at"], "left")
    number = F.when(F.col("_alone") == 1, exist + F.col("_shift")).otherwise(F.col("at") + F.col("_by"))
    return out.select("S", "file", "start", "end", number.cast("int").alias("cluster"))


def _piece_places(tolerance: int, columns: list[str]):
    """Adds the first free place of each file, within its piece; files without an end don't hold theirs."""
    at = [columns.index(c) for c in ("S", "piece", "_start", "_end")]

    def run(batches):
        import pyarrow as pa

        piece, ends = None, _Ends()
        for b in batches:
            which = []
            for s, p, start, end in zip(*(b.column(i).to_pylist() for i in at)):
                if (s, p) != piece:
                    piece, ends = (s, p), _Ends()
                k = None if start is None else ends.first(start + tolerance)
                if k is None:
                    k = ends.n
                    if start is not None and end is not None:
                        ends.add(end)
                elif end is not None:
                    ends.put(k, max(end, ends.low[ends.room + k]))
                which.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(which, pa.int32())], names=[*columns, "at"])

    return run


class _Ends:
    """Ends of clusters; the first that isn't after a time is found by the logarithm of their number."""

    never = float("inf")

    def __init__(self):
        self.n, self.room, self.low = 0, 1, [self.never, self.never]

    def first(self, upto: int) -> int | None:
        if self.low[1] > upto:
            return None
        k = 1
        while k < self.room:
            k = 2 * k if self.low[2 * k] <= upto else 2 * k + 1
        return k - self.room

    def put(self, i: int, end: int | None) -> None:
        k = i + self.room
        self.low[k] = self.never if end is None else end
        while k > 1:
            k //= 2
            self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])

    def add(self, end: int | None) -> int:
        if self.n == self.room:
            ends, self.room = self.low[self.room :], 2 * self.room
            self.low = [self.never] * self.room + ends + [self.never] * (self.room - len(ends))
            for k in range(self.room - 1, 0, -1):
                self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])
        self.n += 1
        self.put(self.n - 1, end)
        return self.n - 1


def _cluster_files(tolerance: int):
    def run(batches):
        import pyarrow as pa

        session, ends = object(), _Ends()
        for b in batches:
            which = []
            for s, start, end in zip(*(b.column(i).to_pylist() for i in (0, 4, 5))):
                if s != session:
                    session, ends = s, _Ends()
                k = None if start is None else ends.first(start + tolerance)
                if k is None:
                    k = ends.add(end)
                elif end is not None:
                    ends.put(k, max(end, ends.low[ends.room + k]))
                which.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(which, pa.int32())], names=["S", "file", "start", "end", "cluster"])

    return run


def chat_toc(sectioned: DataFrame, turned: DataFrame, labels: DataFrame) -> DataFrame:
    """(S, place, level, title): a section's label (2), the current one's only beside others, and each user turn's first line (5)."""
    several = labels.groupBy("S").agg(F.count("*").alias("n"))
    heads = labels.join(several, "S").where("kind <> 'current' or n > 1").select("S", "section_no", F.lit(-1).cast("long").alias("ord"), F.lit(2).alias("level"), F.col("kind").alias("title"))
    name, _ = T.command_output("turn_text")
    text = T.strip("turn_text")
    title = F.when(F.col("subtype") == "command-output", F.when(name == "System", "Terminal").otherwise(name)).otherwise(F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(50)))
    rows = turned.where(F.col("starts_turn") & ~text.startswith(T.SUMMARY_PREFIX)).select("S", "section_no", F.col("ord").cast("long").alias("ord"), F.lit(5).alias("level"), title.alias("title"))
    place = F.row_number().over(Window.partitionBy("S").orderBy("section_no", "ord"))
    return heads.unionByName(rows).select("S", place.alias("place"), "level", "title")


def doc_lines(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, line, in_code): lines with whether they belong to a code block, its fences included."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("n", "x"))
    return rows.select("id", "n", "x.line", "x.in_code")


def _named(rows: DataFrame) -> DataFrame:
    """Lines with title and base, its slug, as they are if the line is a heading; not inside a condition, where Spark computes again what it has computed."""
    title = T.strip(F.regexp_replace(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1), r"\*\*|`", ""))
    return rows.withColumn("title", title).withColumn("base", T.slug("title"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Lines with slug: base, and a number if it is repeated."""
    nth = F.row_number().over(Window.partitionBy("id", "base").orderBy("n")) - 1
    return rows.withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") > 0, F.concat_ws("-", "base", "nth")).otherwise(F.col("base")))


def heading_toc(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """F8: (id, n, level, title, slug) of headings outside code; a repeated slug gets its number."""
    rows = _numbered(_named(doc_lines(docs, id_col, text_col).where(~F.col("in_code") & F.col("line").rlike(r"^#{1,6}\s+.+$"))))
    return rows.select("id", "n", F.length(F.regexp_extract("line", "^(#{1,6})", 1)).alias("level"), "title", "slug")


def source_lines(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, line, is_heading, slug): a heading line needs a space after its hashes; the i-th one has the i-th slug of the outline.

    Lines are dealt by document once, and all windows are within that. Nearly always the i-th heading line is the i-th of the outline too;
    where it isn't, the outline's row comes as a row of its own to the line that has its number.
    """
    flags = {"is_heading": ~F.col("in_code") & F.col("line").rlike("^#{1,6} "), "is_title": ~F.col("in_code") & F.col("line").rlike(r"^#{1,6}\s+.+$")}
    rows = _named(doc_lines(docs, id_col, text_col)).withColumns(flags).drop("in_code", "title").repartition("id")
    rows = _numbered(rows.withColumn("base", F.when(F.col("is_title"), F.col("base"))))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    number = lambda c: F.when(c, F.sum(c.cast("int")).over(w))
    rows = rows.withColumns({"i": number(F.col("is_heading")), "j": number(F.col("is_title"))})
    same = F.coalesce(F.col("i") == F.col("j"), F.lit(False))
    own = F.struct(F.lit(True).alias("is_line"), F.coalesce("i", -1 - F.col("n")).alias("key"), F.when(same, F.col("slug")).alias("given"))
    other = F.when(F.col("j").isNotNull() & ~same, F.struct(F.lit(False).alias("is_line"), F.col("j").alias("key"), F.col("slug").alias("given")))
    rows = rows.withColumn("_x", F.explode(F.array_compact(F.array(own, other))))
    line = F.when(F.col("_x.is_line"), F.col("line"))
    rows = rows.select("id", "n", line.alias("line"), "is_heading", "_x.*").withColumn("slug", F.max("given").over(Window.partitionBy("id", "key")))
    return rows.where("is_line").select("id", "n", "line", "is_heading", "slug")


def demote_headings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text) with headings outside code as bold text."""
    return docs.select(F.col(id_col).alias("id"), T.bold_headings(text_col).alias("text"))
