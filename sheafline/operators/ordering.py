"""Sort modes, siblings and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import transliterate

MODES = ("date", "update_date", "title", "title_bytes", "weight", "slug", "permalink", "none")


def measured(digits: Column) -> Column:
    """A digit run behind its length in ten places: as text it sorts by value, however long it is."""
    return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)


def natural_key(s: Column) -> Column:
    """Sorts as people do: no case, no accents, Greek spelled out, digit runs by their value."""
    plain = F.lower(transliterate(s))
    parts = F.regexp_extract_all(plain, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), measured(F.regexp_replace(x, r"^0+(\d)", "$1"))).otherwise(x)), "")


def sort_key(by: str, date="date", updated="updated", title="title", weight="weight", slug="slug", permalink="permalink") -> tuple[Column, bool]:
    """(key, descending) of a sort mode; rows whose key is null can't be sorted by it."""
    c = F.col
    keys = {
        "date": (c(date), True), "update_date": (F.greatest(c(date), c(updated)) if date != updated else c(date), True),
        "title": (natural_key(c(title)), False), "title_bytes": (c(title), False), "weight": (c(weight), False),
        "slug": (natural_key(c(slug)), False), "permalink": (c(permalink), False),
    }
    return keys[by]


def order(by: str, permalink: str = "permalink", **columns) -> list[Column]:
    """The order of a mode; ties go by permalink, rising also under a falling key."""
    key, falling = sort_key(by, permalink=permalink, **columns)
    return [key.desc() if falling else key.asc(), F.col(permalink).asc()]


def _dealt(rows: DataFrame, group: list[str], keys: list[Column]) -> DataFrame:
    """rows range-partitioned and sorted by group and keys, with __at, their place: the partition's number in the upper bits, places without gaps in the lower 33."""
    from ..sources.shared import materialize

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [F.col(g) for g in group]
    return materialize(rows.repartitionByRange(n, *names, *keys).sortWithinPartitions(*names, *keys).withColumn("__at", F.monotonically_increasing_id()), "dealt")


def _runs(dealt: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """One row for each group in each partition (__part): its first and last place, how many rows of the group stand in partitions before (__base), and more."""
    per = dealt.groupBy(F.shiftright("__at", 33).alias("__part"), *group).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count("*").alias("__n"), *more)
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def _with_runs(dealt: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """dealt with its runs' columns; null groups meet as well. No key is hot: a group's rows are dealt over its partitions."""
    own = dealt.withColumn("__part", F.shiftright("__at", 33)).alias("d")
    on = [F.col("d.__part") == F.col("r.__part"), *[F.col(f"d.`{g}`").eqNullSafe(F.col(f"r.`{g}`")) for g in group]]
    extra = [F.col(f"r.`{x}`") for x in runs.columns if x not in ("__part", *group)]
    return own.join(runs.alias("r"), on).select(*[F.col(f"d.`{x}`") for x in dealt.columns], *extra)


def group_rank(rows: DataFrame, group: list[str], keys: list[Column], out: str = "rank") -> DataFrame:
    """Numbers each group's rows from 1 in the order of keys, as a long, whatever the groups' sizes.

    Rows are range-partitioned and sorted by group and keys, so a large group lies in many
    partitions. A row's rank is its place in its partition plus the group's rows in
    partitions before; only a row per group and partition meets in a window.
    """
    dealt = _dealt(rows, group, keys)
    ranked = _with_runs(dealt, _runs(dealt, group).select("__part", *group, "__first", "__base"), group)
    return ranked.withColumn(out, F.col("__at") - F.col("__first") + F.col("__base") + 1).drop("__at", "__first", "__base")


def sort_pages(pages: DataFrame, by: str, group: str | None = None, permalink: str = "permalink", **columns) -> tuple[DataFrame, DataFrame]:
    """(sorted, unsortable): sorted has a rank from 1 within its group; unsortable has null keys. `none` sorts nothing."""
    if by == "none":
        return pages.withColumn("rank", F.lit(None).cast("long")), pages.limit(0)
    key, _ = sort_key(by, permalink=permalink, **columns)
    return group_rank(pages.where(key.isNotNull()), [group] if group else [], order(by, permalink, **columns)), pages.where(key.isNull())


def sort_sections(sections: DataFrame, by: str, group: str | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """Titles and permalinks sort as pages do; every other mode, `none` too, means weight."""
    return sort_pages(sections, by if by in ("title", "title_bytes", "permalink") else "weight", group, **columns)


def siblings(pages: DataFrame, by: str, group: str, permalink: str = "permalink", **columns) -> DataFrame:
    """Sortable pages with lower and higher: the permalinks before and after in the group's order.

    Rows are range-partitioned by group and order; neighbours in a partition come from its
    window, those beyond its ends from the first and last rows of the group's other partitions.
    """
    c = F.col
    key, _ = sort_key(by, permalink=permalink, **columns)
    dealt = _dealt(pages.where(key.isNotNull()), [group], order(by, permalink, **columns))
    runs = _runs(dealt, [group], F.min_by(permalink, "__at").alias("__head"), F.max_by(permalink, "__at").alias("__tail"))
    order_of_runs = Window.partitionBy(group).orderBy("__part")
    ends = runs.withColumns({"__before": F.lag("__tail").over(order_of_runs), "__after": F.lead("__head").over(order_of_runs)}).select("__part", group, "__first", "__last", "__before", "__after")
    inside = Window.partitionBy(F.shiftright("__at", 33), group).orderBy("__at")
    near = dealt.withColumns({"__lower": F.lag(permalink).over(inside), "__higher": F.lead(permalink).over(inside)})
    whole = _with_runs(near, ends, [group])
    return whole.withColumns({"lower": F.when(c("__at") == c("__first"), c("__before")).otherwise(c("__lower")), "higher": F.when(c("__at") == c("__last"), c("__after")).otherwise(c("__higher"))}) \
        .drop("__at", "__first", "__last", "__before", "__after", "__lower", "__higher")


def top_k(rows: DataFrame, k: int | None, keys: list[Column], group: list[str] | None = None) -> DataFrame:
    """The first k rows of each group (all for None), with their rank.

    Without a group, a limit comes first, which Spark keeps per partition; with one,
    Spark prunes each partition to k rows before the shuffle.
    """
    if not group and k is not None:
        rows = rows.orderBy(*keys).limit(k)
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*keys)))
    return out if k is None else out.where(F.col("rank") <= k)


def global_rank(rows: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """Numbers all rows from 1 in the order of these columns without one task sorting everything."""
    return group_rank(rows, [], [F.col(k) for k in keys], out)
