"""Folders, placements, titles and notes: joins with sessions, and change tables applied to them.

folders: (id, name, parent_id, …). members: (folder_id, member_id). meta: (id, custom_title, notes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators.durable import dropped, stored


def attach_meta(summary: DataFrame, meta: DataFrame) -> DataFrame:
    """Summary rows (id, S, is_branch) with custom_title and notes: by session, else by id; a branch by its own id only."""
    by_s = meta.select(F.col("id").alias("S"), F.struct("custom_title", "notes").alias("_s"))
    by_id = meta.select("id", F.struct("custom_title", "notes").alias("_i"))
    m = F.when(F.col("is_branch"), F.col("_i")).otherwise(F.coalesce("_s", "_i"))
    return summary.join(by_s, "S", "left").join(by_id, "id", "left").withColumns({"custom_title": m["custom_title"], "notes": m["notes"]}).drop("_s", "_i")


def ungrouped(summary: DataFrame, members: DataFrame) -> DataFrame:
    """D3: rows (id, S, is_branch) placed in no folder: neither by id nor, unless a branch, by session."""
    placed = members.select("member_id").distinct()
    return summary.join(placed, F.col("id") == F.col("member_id"), "left_anti").join(placed, (F.col("S") == F.col("member_id")) & ~F.col("is_branch"), "left_anti")


def turn_split(summary: DataFrame) -> DataFrame:
    """C6."""
    return summary.withColumn("is_multi_turn", F.col("turn_count") > 1)


def folder_sessions(members: DataFrame, summary: DataFrame) -> DataFrame:
    """(folder_id, id): members resolved by row id, else by session id (its first row)."""
    by_id = summary.select(F.col("id").alias("member_id"), F.col("id").alias("_a"))
    by_s = summary.groupBy(F.col("S").alias("member_id")).agg(F.min("id").alias("_b"))
    found = members.join(by_id, "member_id", "left").join(by_s, "member_id", "left")
    return found.select("folder_id", F.coalesce("_a", "_b").alias("id")).where("id is not null")


def folder_totals(folders: DataFrame, members: DataFrame, summary: DataFrame) -> DataFrame:
    """(folder_id, own, total): own resolved sessions, plus the raw members of direct children."""
    own = folder_sessions(members, summary).groupBy("folder_id").agg(F.count("*").alias("own"))
    raw = members.groupBy("folder_id").agg(F.count("*").alias("n"))
    below = folders.select(F.col("id").alias("folder_id"), "parent_id").join(raw, "folder_id").groupBy(F.col("parent_id").alias("folder_id")).agg(F.sum("n").alias("below"))
    all_ = folders.select(F.col("id").alias("folder_id")).join(own, "folder_id", "left").join(below, "folder_id", "left")
    return all_.select("folder_id", F.coalesce("own", F.lit(0)).alias("own"), (F.coalesce("own", F.lit(0)) + F.coalesce("below", F.lit(0))).alias("total"))


def distinct_members(members: DataFrame) -> DataFrame:
    """J2."""
    return members.select("folder_id", "member_id").dropDuplicates()


def inject_branch_members(members: DataFrame, placements: DataFrame, folders: DataFrame) -> DataFrame:
    """Placements (folder_id, member_id) of branches in known folders, added."""
    known = folders.select(F.col("id").alias("folder_id"))
    return distinct_members(members.select("folder_id", "member_id").unionByName(placements.select("folder_id", "member_id").join(known, "folder_id", "left_semi")))


def image_gallery(m: DataFrame, images: DataFrame) -> DataFrame:
    """(S, ord, i, path, image_ord, is_pasted): the images that users show. m: (S, ord, type, ts, text), images: (S, ord, i) inline.

    The i-th path of a text goes with the i-th inline image of the first other user message of
    the same time (image_ord; null: none). Inline images count of themselves only where no text has paths at their time.
    """
    users = m.where("type = 'user'").select("S", "ord", "ts", "text")
    paths = users.select("S", "ord", "ts", F.posexplode(T.image_paths("text")).alias("i", "path"))
    shown = images.join(users.select("S", "ord", "ts"), ["S", "ord"])
    nth = F.row_number().over(Window.partitionBy("S", "ts").orderBy("ord"))
    firsts = shown.select("S", "ts", "ord").distinct().withColumn("nth", nth).where("nth <= 2").groupBy("S", "ts").agg(F.min("ord").alias("a"), F.max("ord").alias("b"))
    other = F.when(F.col("a") != F.col("ord"), F.col("a")).when(F.col("b") != F.col("ord"), F.col("b"))
    paired = paths.join(firsts, ["S", "ts"], "left").withColumn("at", other)
    has = images.select("S", F.col("ord").alias("at"), "i", F.col("ord").alias("image_ord"))
    paired = paired.join(has, ["S", "at", "i"], "left").select("S", "ord", "i", "path", "image_ord", F.lit(False).alias("is_pasted"))
    alone = shown.join(paths.select("S", "ts").distinct(), ["S", "ts"], "left_anti")
    return paired.unionByName(alone.select("S", "ord", "i", F.lit(None).cast("string").alias("path"), F.col("ord").alias("image_ord"), F.lit(True).alias("is_pasted")))


def attach_export_paths(summary: DataFrame, exports: DataFrame) -> DataFrame:
    """export_path: the row's own document, else its session's."""
    own = exports.select("id", F.col("path").alias("_own"))
    of_s = exports.select(F.col("id").alias("S"), F.col("path").alias("_s"))
    return summary.join(own, "id", "left").join(of_s, "S", "left").withColumn("export_path", F.coalesce("_own", "_s")).drop("_own", "_s")


def branch_neighbours(summary: DataFrame) -> DataFrame:
    """(id, parent_title, n_children) by parent_id; a title is custom, or 40 characters of the first message, or 12 of the id."""
    title = F.coalesce(T.present("custom_title"), T.present(F.left("first_user_message", F.lit(40))), F.left("id", F.lit(12)))
    parents = summary.select(F.col("id").alias("parent_id"), title.alias("parent_title"))
    children = summary.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return summary.select("id", "parent_id").join(parents, "parent_id", "left").join(children, "id", "left").select("id", "parent_title", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def folder_order(folders: DataFrame, order: DataFrame) -> DataFrame:
    """H4: place among siblings: those in ``order`` (id, pos) by position, then the rest by name."""
    w = Window.partitionBy("parent_id").orderBy(F.col("pos").isNull(), "pos", "name", "id")
    return folders.join(order.select("id", "pos"), "id", "left").withColumn("place", F.row_number().over(w)).drop("pos")


def reorder_folders(folders: DataFrame, order: DataFrame, moves: DataFrame) -> DataFrame:
    """H5: (id, place) after moves (id, target, side 'before' or 'after') within siblings; an unknown target means the end."""
    placed = folder_order(folders, order).select("id", "parent_id", F.col("place").cast("double").alias("at"))
    to = placed.select(F.col("id").alias("target"), F.col("at").alias("to"))
    m = moves.join(to, "target", "left").select("id", F.when(F.col("to").isNull(), F.lit(float("inf"))).when(F.col("side") == "before", F.col("to") - 0.5).otherwise(F.col("to") + 0.5).alias("new"))
    at = placed.join(m, "id", "left").withColumn("at", F.coalesce("new", "at"))
    return at.select("id", "parent_id", F.row_number().over(Window.partitionBy("parent_id").orderBy("at", "id")).alias("place"))


def folder_closure(folders: DataFrame) -> DataFrame:
    """M1: (ancestor, descendant, depth), each folder being its own at depth 0: pointer doubling, as many rounds as the logarithm of the depth."""
    jump = folders.where("parent_id is not null").join(folders.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("id").alias("node"), F.col("parent_id").alias("to"))
    out = stored(folders.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth")), "closure")
    jump = stored(jump, "jump")
    reach = 1
    n = max(1, folders.count())
    while reach <= n and not jump.isEmpty():
        more = out.join(jump, F.col("ancestor") == F.col("node")).select(F.col("to").alias("ancestor"), "descendant", (F.col("depth") + reach).alias("depth"))
        wider = stored(out.unionByName(more).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")), "closure")
        farther = stored(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to"), "jump")
        dropped(out, jump)
        out, jump = wider, farther
        reach *= 2
    dropped(jump)
    return out


def _nearest_moved(folders: DataFrame, moved: DataFrame) -> DataFrame:
    """(id, to): for each folder the nearest one of ``moved`` (id) at or above it, by pointer doubling that stops there; null without one."""
    here = folders.join(moved.withColumn("_m", F.lit(True)), "id", "left")
    known = folders.select(F.col("id").alias("up"), F.lit(True).alias("_k"))
    step = here.select("id", "_m", F.col("parent_id").alias("up")).join(known, "up", "left")
    at = stored(step.select("id", F.when(F.col("_m"), F.col("id")).when(F.col("_k"), F.col("up")).alias("to"), F.coalesce("_m", F.lit(False)).alias("done")), "nearest")
    while True:
        open_ = at.where("not done and to is not null")
        if open_.isEmpty():
            return at
        up = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        # a pointer that meets a moved folder ends there, one that meets a root without any ends nowhere
        met = open_.join(up, "to", "left").select("id", F.when(F.col("_done"), F.col("to")).otherwise(F.col("_to")).alias("to"), F.coalesce(F.col("_done"), F.lit(False)).alias("done"))
        more = met.join(moved.select(F.col("id").alias("to"), F.lit(True).alias("_m")), "to", "left").select("id", "to", (F.col("done") | F.coalesce("_m", F.lit(False))).alias("done"))
        now = stored(at.where("done or to is null").unionByName(more), "nearest")
        dropped(at)
        at = now


def _groups(edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id that ``edges`` (a, b) lead to; labels and pointers take each other's minima until none falls."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stored(both.select(F.col("a").alias("id"), F.col("a").alias("group")).distinct(), "groups")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("group").alias("g")), "b").select(F.col("a").alias("id"), "g")
        low = near.unionByName(label.select("id", F.col("group").alias("g"))).groupBy("id").agg(F.min("g").alias("g"))
        # a label's own label is as good: halves the way that is left
        far = low.join(label.select(F.col("id").alias("g"), F.col("group").alias("gg")), "g", "left").select("id", F.least("g", "gg").alias("group"))
        new = stored(far, "groups")
        same = new.exceptAll(label).isEmpty()
        dropped(label)
        label = new
        if same:
            dropped(both)
            return label


def apply_folder_moves(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """M2: folders with the parents that moves (id, parent_id, seq) give, one after another by seq (equal ones by parent); into itself, a folder then below it or an unknown folder is refused.

    Only moved folders' parents change, so a way up is a chain of moved folders with fixed stretches between: each folder's nearest moved one is found once,
    over all folders. Moves are then replayed in order over these chains, each group of moved folders that chains can join by itself: a task
    holds a group's moves, not its folders.
    """
    m = moves.select("id", F.col("parent_id").alias("new_parent"), *(["seq"] if "seq" in moves.columns else [F.lit(0).alias("seq")]))
    m = m.join(folders.select("id"), "id", "left_semi")
    known = folders.select(F.col("id").alias("new_parent"))
    m = stored(m.where("new_parent is null").unionByName(m.where("new_parent is not null").join(known, "new_parent", "left_semi").select(m.columns)), "moves")
    moved = m.select("id").distinct()
    nearest = _nearest_moved(folders, moved)
    place = nearest.where("done").select(F.col("id").alias("new_parent"), F.col("to").alias("goal"))
    start = folders.join(moved, "id", "left_semi").select("id", F.col("parent_id").alias("new_parent"))
    chains = start.join(place, "new_parent", "left").select("id", F.lit(None).cast("string").alias("new_parent"), "goal", F.lit(None).cast(m.schema["seq"].dataType).alias("seq"), F.lit(True).alias("is_start"))
    steps = m.join(place, "new_parent", "left").select("id", F.col("new_parent").cast("string").alias("new_parent"), "goal", "seq", F.lit(False).alias("is_start"))
    rows = stored(chains.unionByName(steps), "steps")
    group = _groups(rows.select(F.col("id").alias("a"), F.coalesce("goal", "id").alias("b")))
    kind = folders.schema["id"].dataType.simpleString()
    ordered = rows.join(group, "id").repartition("group").sortWithinPartitions("group", F.desc("is_start"), "seq", "new_parent", "id")
    done = stored(ordered.select("group", "id", "new_parent", "goal", "is_start").mapInPandas(_replayed, f"id {kind}, new_parent string"), "moved")
    out = folders.join(done.withColumn("_moved", F.lit(True)), "id", "left")
    dropped(m, nearest, rows, group)
    return out.withColumn("parent_id", F.when(F.col("_moved"), F.col("new_parent").cast(folders.schema["parent_id"].dataType)).otherwise(F.col("parent_id"))).select(*folders.columns)


def _replayed(batches):
    """(id, new_parent) of the moves that stand in the end; rows come group by group, chains (is_start) first, then moves in order."""
    import pandas as pd

    group, chain, parent = None, {}, {}
    for b in batches:
        out = []
        for g, x, p, goal, start in zip(b["group"], b["id"], b["new_parent"], b["goal"], b["is_start"]):
            if g != group:
                out += parent.items()
                group, chain, parent = g, {}, {}
            if start:
                chain[x] = goal
                continue
            at = goal
            while at is not None and at != x:
                at = chain.get(at)
            if at is None:
                chain[x], parent[x] = goal, p
        yield pd.DataFrame(out, columns=["id", "new_parent"])
    yield pd.DataFrame(list(parent.items()), columns=["id", "new_parent"])


def delete_folders(folders: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: folders and members without the folders ``gone`` (id) and all below them."""
    all_gone = folder_closure(folders).join(gone.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
    return folders.join(all_gone, "id", "left_anti"), members.join(all_gone.withColumnRenamed("id", "folder_id"), "folder_id", "left_anti")


def assign_sessions(members: DataFrame, changes: DataFrame) -> DataFrame:
    """M4: members after changes (member_id, folder_id, mode 'move' or 'add', seq).

    The latest move of a member removes its memberships and earlier additions; a move to
    no folder (null) only removes. Additions keep the others.
    """
    moves = changes.where("mode = 'move'").groupBy("member_id").agg(F.max("seq").alias("at"), F.max_by("folder_id", "seq").alias("to"))
    kept = members.select("folder_id", "member_id").join(moves, "member_id", "left_anti").select("folder_id", "member_id")
    moved = moves.where("to is not null").select(F.col("to").alias("folder_id"), "member_id")
    added = changes.where("mode = 'add'").join(moves.drop("to"), "member_id", "left").where("at is null or seq > at").select("folder_id", "member_id")
    return distinct_members(kept.unionByName(moved).unionByName(added))


def patch_meta(meta: DataFrame, patch: DataFrame, fields: tuple[str, ...] = ("custom_title", "notes")) -> DataFrame:
    """M6: meta after patch (id, a field and has_<field> each): only supplied fields change."""
    p = patch.select("id", *(F.col(f).alias(f"_{f}") for f in fields), *(f"has_{f}" for f in fields))
    j = meta.join(p, "id", "full_outer")
    return j.select("id", *(F.when(F.coalesce(f"has_{f}", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def apply_highlights(highlights: DataFrame, added: DataFrame, removed: DataFrame, quote: int = 2000) -> DataFrame:
    """M7: highlights (session_id, id, text, seq) without the removed ids, and the added ones, whose quotes are cut."""
    new = added.withColumn("text", F.left("text", F.lit(quote)))
    return highlights.join(removed.select("id"), "id", "left_anti").unionByName(new.select(*highlights.select("id", *[c for c in highlights.columns if c != "id"]).columns))


def rename_paths(df: DataFrame, old: str, new: str, path_col: str = "path") -> DataFrame:
    """M8: the path itself and those below it."""
    p = F.col(path_col)
    return df.withColumn(path_col, F.when((p == old) | p.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p)))).otherwise(p))


def unique_names(df: DataFrame, parent_col: str = "parent", name_col: str = "name", order: str = "id") -> DataFrame:
    """M9: safe_name; of equal ones under a parent, in order, each takes the first free ``<name> (n)`` from 2.

    Names meet only if they are equal without their numbers in brackets. Where no name brings such a number, a name's n-th row takes n. Where some do,
    numbers may be taken already: those rows are streamed in order, each name with a pointer to its first number that may be free.
    """
    base = df.withColumn("_base", T.safe_name(name_col)).withColumn("_stem", F.regexp_replace("_base", r"( \(\d+\))+$", ""))
    numbered = base.where("_base <> _stem").select(F.coalesce(F.col(parent_col).cast("string"), F.lit("")).alias("_p"), F.col(parent_col).isNull().alias("_no"), "_stem").distinct().withColumn("_mixed", F.lit(True))
    base = base.withColumns({"_p": F.coalesce(F.col(parent_col).cast("string"), F.lit("")), "_no": F.col(parent_col).isNull()}).join(numbered, ["_p", "_no", "_stem"], "left")
    nth = F.row_number().over(Window.partitionBy("_p", "_no", "_base").orderBy(order))
    plain = base.where("_mixed is null").withColumn("_n", nth)
    plain = plain.withColumn("safe_name", F.when(F.col("_n") > 1, F.concat(F.col("_base"), F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(F.col("_base")))
    mixed = base.where("_mixed").select("_p", "_no", "_stem", "_base", *df.columns)
    place = ["_p", "_no", "_stem"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    mixed = mixed.repartition(*place).sortWithinPartitions(*place, order).mapInArrow(_free_names(df.columns), f"{types}, safe_name string")
    return plain.select(*df.columns, "safe_name").unionByName(mixed)


def _free_names(columns: list[str]):
    def run(batches):
        import pyarrow as pa

        group, taken, nxt = None, set(), {}
        for b in batches:
            names = []
            for *at, name in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at != group:
                    group, taken, nxt = at, set(), {}
                free, n = name, nxt.get(name, 2)
                while free in taken:
                    free, n = f"{name} ({n})", n + 1
                if free != name:
                    nxt[name] = n
                taken.add(free)
                names.append(free)
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(names, pa.string())], names=[*columns, "safe_name"])

    return run


def load_folder_tree(flat: DataFrame) -> DataFrame:
    """Folders of a flat list that hang on a root through known parents, with their level; orphans go."""
    roots = flat.where("parent_id is null").select(F.col("id").alias("ancestor"))
    level = folder_closure(flat).join(roots, "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("depth").alias("level"))
    return flat.join(level, "id")


def says_something(meta: DataFrame, highlights: DataFrame) -> DataFrame:
    """Meta rows with a title, notes or highlights, and n_highlights."""
    n = highlights.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_highlights"))
    out = meta.join(n, "id", "left").withColumn("n_highlights", F.coalesce("n_highlights", F.lit(0)))
    return out.where("coalesce(custom_title, '') <> '' or coalesce(notes, '') <> '' or n_highlights > 0")


def flatten_library(
    folders: DataFrame, order: DataFrame, members: DataFrame, meta: DataFrame, highlights: DataFrame, branch_members: DataFrame, branch_meta: DataFrame
) -> dict[str, DataFrame]:
    """Folders (with way), members and meta of a library.

    way: the places among siblings (H4) from the root down to the folder; folders sorted by it come each
    before what is below it. Branches are placed in known folders (D5). Sessions' meta are there only if they
    say something; a branch's meta (id, custom_title, notes, n_highlights) stands in any case, in place of any other of that id.
    """
    placed = folder_order(folders, order).select(F.col("id").alias("ancestor"), "place")
    way = folder_closure(folders).join(placed, "ancestor").groupBy(F.col("descendant").alias("id")).agg(
        F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("depth", "place")))), lambda x: x["place"]).alias("way")
    )
    own = says_something(meta, highlights).join(branch_meta.select("id"), "id", "left_anti")
    return {
        "folders": folders.join(way, "id"),
        "members": inject_branch_members(members, branch_members, folders),
        "meta": own.select("id", "custom_title", "notes", "n_highlights").unionByName(branch_meta.select("id", "custom_title", "notes", "n_highlights")),
    }
