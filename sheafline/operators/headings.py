"""Headings: parents, ids, footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once


def toc_parents(headings: DataFrame, page: str) -> DataFrame:
    """headings (page, pos, level) with parent_pos: the last earlier heading of a smaller level; null at the top.

    One window per page: the latest position of each level so far, then the largest
    of those of smaller levels.
    """
    w = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("pos"))).over(w) for n in range(1, 7)]
    smaller = [F.when(F.col("level") > n, last[n - 1]) for n in range(1, 7)]
    return headings.withColumn("parent_pos", F.greatest(*smaller))


def unique_ids(slugs: Column, explicit: Column) -> Column:
    """Ids for an array of heading slugs in order: explicit ids (same length, null where none) are taken first, then x, x-1, x-2 and so on.

    A fold in SQL over one page's headings: taken ids are carried along.
    """
    taken = F.filter(explicit, lambda x: x.isNotNull())
    pairs = F.arrays_zip(slugs.alias("s"), explicit.alias("e"))

    def step(acc, p):
        name = lambda i: F.when(i == 0, p["s"]).otherwise(F.concat(p["s"], F.lit("-"), i.cast("string")))
        # of one name more than are taken, one is free
        free = F.get(F.array_except(F.transform(F.sequence(F.lit(0), F.size(acc["taken"])), name), acc["taken"]), 0)
        own = F.coalesce(p["e"], F.when(~F.array_contains(acc["taken"], p["s"]), p["s"]).otherwise(free))
        return once(own, lambda x: F.struct(F.array_append(acc["ids"], x).alias("ids"), F.when(p["e"].isNull(), F.array_append(acc["taken"], x)).otherwise(acc["taken"]).alias("taken")))

    start = F.struct(F.array().cast("array<string>").alias("ids"), taken.cast("array<string>").alias("taken"))
    return F.aggregate(pairs, start, step)["ids"]


def footnote_numbers(refs: DataFrame, page: str) -> DataFrame:
    """refs (page, pos, name) with number (by first reference) and ref (1, 2, ... for each name)."""
    by_name = Window.partitionBy(page, "name")
    out = refs.withColumns({"__first": F.min("pos").over(by_name), "ref": F.row_number().over(by_name.orderBy("pos"))})
    return out.withColumn("number", F.dense_rank().over(Window.partitionBy(page).orderBy("__first"))).drop("__first")
