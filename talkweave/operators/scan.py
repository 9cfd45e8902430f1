"""Running sums and carried values over very long groups: a scan of blocks, then of their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.operators.durable import stored

BLOCK = 1 << 16


def blocked(df: DataFrame, order: str = "ord", size: int = BLOCK) -> DataFrame:
    """``df`` with _block: stretches of ``size`` of a whole-number order, so that no group's rows of a block are more than the rows of so many places."""
    return df.withColumn("_block", F.floor(F.col(order) / size).cast("long"))


def ranged(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``df``, stored, with _block: the ranges into which Spark sorts it by ``by`` and ``order``."""
    return stored(df.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (with _block) and running columns within ``by`` in ``order``, of which _block must be a coarser form.

    sums: as far as the row itself. lasts, maxes: the last value that isn't null, and the largest one, strictly before the row. Each block is scanned by itself, blocks'
    totals are scanned for what comes before them, a row for each block of a group, and joined on. So a group of very many
    rows is as many tasks as it has blocks, and its order is never in one of them. Columns of ``by`` aren't null.
    """
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    at = [*by, "_block"]
    inside = Window.partitionBy(*at).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    own = df.withColumns({f"_in_{n}": F.sum(e).over(upto) for n, e in sums.items()} | {f"_in_{n}": F.last(e, ignorenulls=True).over(before) for n, e in lasts.items()} | {f"_in_{n}": F.max(e).over(before) for n, e in maxes.items()})
    totals = df.groupBy(*at).agg(*(F.sum(e).alias(n) for n, e in sums.items()), *(F.max_by(e, F.when(e.isNotNull(), place)).alias(n) for n, e in lasts.items()), *(F.max(e).alias(n) for n, e in maxes.items()))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*at, *(F.sum(n).over(earlier).alias(f"_off_{n}") for n in sums), *(F.last(n, ignorenulls=True).over(earlier).alias(f"_off_{n}") for n in lasts), *(F.max(n).over(earlier).alias(f"_off_{n}") for n in maxes))
    both = own.join(offsets, at)
    found = {n: F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_off_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"_in_{n}", f"_off_{n}") for n in lasts} | {n: F.greatest(f"_in_{n}", f"_off_{n}") for n in maxes}
    return both.withColumns(found).select(*df.columns, *found)


def by_length(df: DataFrame, by: tuple[str, ...], size: int, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``short`` of the groups of at most ``size`` rows and, where there are longer ones, ``long`` of those; both give the same rows for any group."""
    groups = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(*by)
    if groups.isEmpty():
        return short(df)
    most = short(df.join(groups, list(by), "left_anti"))
    return most.unionByName(long(df.join(groups, list(by), "left_semi")).select(most.columns))
