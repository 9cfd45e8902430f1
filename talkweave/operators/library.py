"""All rows of a library of sessions: a row for each cluster of continuing files, and one for each branch inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.operators import lineage
from talkweave.operators.sequence import continuation_clusters
from talkweave.operators.summary import session_summary


def file_ranges(m: DataFrame) -> DataFrame:
    """(S, file, start, end): a file's first and last time, of the main chain or, without any there, of all rows."""
    main = F.when(~F.coalesce("is_sidechain", F.lit(False)), F.col("ts"))
    return m.groupBy("S", "file").agg(F.coalesce(F.min(main), F.min("ts")).alias("start"), F.coalesce(F.max(main), F.max("ts")).alias("end"))


def placed_messages(m: DataFrame) -> DataFrame:
    """Messages (S, file, ord, ...) with cluster, row_id (the id of its row), primary_file, and ord as (start of the file, file, line)."""
    clusters = continuation_clusters(file_ranges(m))
    named = clusters.join(lineage.cluster_ids(clusters).withColumnRenamed("id", "row_id"), ["S", "cluster"]).drop("end")
    place = F.struct("start", F.col("file").alias("in_file"), F.col("ord").alias("line"))
    return m.join(named, ["S", "file"]).withColumn("ord", place).drop("start")


def library_rows(m: DataFrame) -> DataFrame:
    """(id, S, cluster, primary_file, parent_id, child_ids, point, leaf, and the columns of ``session_summary``), one row for each id.

    A session whose files overlap has a row for each cluster, ``<S>:branch-<i>``, whose parent is the cluster that holds its first parent
    pointer. Branches inside a row's files are ``<id of the row>:intra-<n>``. Only rows with several leaves are searched for branches.
    """
    placed = placed_messages(m)
    facts = placed.select(F.col("row_id").alias("id"), "S", "cluster", "primary_file").distinct()
    by_row = placed.withColumn("S", F.col("row_id"))
    base = session_summary(by_row).withColumns({"id": F.col("S"), "point": F.lit(None).cast("string"), "leaf": F.lit(None).cast("string")})
    e = lineage.edges(by_row)
    forks = lineage.leaves(e).groupBy("S").agg(F.count("*").alias("n")).where("n > 1")
    none = F.expr("cast(array() as array<string>)")
    if forks.isEmpty():
        rows = base.withColumns({"child_ids": none, "parent_id": F.lit(None).cast("string")})
    else:
        forest = lineage.plant(by_row.join(forks.select("S"), "S", "left_semi"), forks_only=True)
        rows = lineage.branch_rows(lineage.branch_facts(lineage.detect_branches(by_row, forest=forest), forest), base)
        forest.drop()
    rows = rows.withColumn("row", F.col("S")).drop("S").join(facts.withColumnRenamed("id", "row"), "row")
    above = lineage.cluster_parents(placed.withColumn("file_no", F.lit(0)))
    ids = facts.select("S", F.col("cluster").alias("parent_cluster"), F.col("id").alias("above"))
    above = above.join(ids, ["S", "parent_cluster"]).select("S", "cluster", "above", F.col("point").alias("from_point"))
    rows = rows.join(above, ["S", "cluster"], "left")
    own = F.col("leaf").isNull()
    return rows.withColumns({"parent_id": F.when(own, F.col("above")).otherwise(F.col("parent_id")), "point": F.when(own, F.col("from_point")).otherwise(F.col("point"))}).drop("above", "from_point", "row")
