"""Pagers: slices of an owner's ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import paginate_url
from .ordering import group_rank


def pager_of(rank: Column, total: Column, by: Column | int, reverse: bool = False) -> Column:
    """The pager of a row from its rank from 1 on; reversed, the last row comes first."""
    by = F.lit(by) if isinstance(by, int) else by
    place = total - rank if reverse else rank - 1
    return (F.floor(place / by) + 1).cast("int")


def fill_pagers(owners: DataFrame, rows: DataFrame, by: int, owner: str, keys: list[Column], reverse: bool = False) -> DataFrame:
    """(owner, pager, place, row columns): each owner's rows in slices of `by`; an owner without rows has pager 1 with nulls.

    Owners are matched by an equi-join; ranks hold for owners of any size, totals are an aggregation.
    """
    totals = rows.groupBy(owner).agg(F.count("*").alias("__total"))
    ranked = group_rank(rows, [owner], keys, "__rank").join(totals, owner)
    place = (F.col("__total") - F.col("__rank") + 1) if reverse else F.col("__rank")
    sliced = ranked.withColumns({"pager": pager_of(F.col("__rank"), F.col("__total"), by, reverse), "place": ((place - 1) % by + 1).cast("int")}).drop("__rank", "__total")
    return owners.select(owner).join(sliced, owner, "left").withColumn("pager", F.coalesce("pager", F.lit(1)))


def pager_context(pagers: DataFrame, owner: str, base: str = "path", paginate_path: str = "paginate_path") -> DataFrame:
    """One row per pager: its URL, those of the first, last, previous and next pager, and counts.

    pagers: (owner, pager, base path, paginate_path, n rows of the pager). The first
    pager is at the owner's own path.
    """
    c = F.col
    url = F.when(c("pager") == 1, c(base)).otherwise(paginate_url(F.when(c(base).endswith("/"), c(base)).otherwise(F.concat(base, F.lit("/"))), c(paginate_path), c("pager")))
    every = Window.partitionBy(owner)
    ordered = every.orderBy("pager")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pagers.withColumn("url", url).withColumns({
        "first": F.first("url").over(whole), "last": F.last("url").over(whole), "previous": F.lag("url").over(ordered), "next": F.lead("url").over(ordered),
        "number_pagers": F.count("*").over(every).cast("int"), "total_pages": F.sum("n").over(every)})


def chunk_number(rank: Column, size: int) -> Column:
    """Chunks of `size` rows from a rank from 1 on, counted from 1."""
    return (F.floor((rank - 1) / size) + 1).cast("int")


def _next_starts(sizes: list[int], pages: list, max_items: int, max_bytes: int, max_pages: int | None) -> list[int]:
    """For each item, where the batch that starts with it would end: two marks that only move on."""
    out, end, total, held = [], 0, 0, {}
    for start in range(len(sizes)):
        if end <= start:
            end, total, held = start, 0, {}
        while end < len(sizes) and (end == start or (end - start < max_items and total + sizes[end] <= max_bytes and (max_pages is None or pages[end] in held or len(held) < max_pages))):
            total += sizes[end]
            held[pages[end]] = held.get(pages[end], 0) + 1
            end += 1
        out.append(end)
        total -= sizes[start]
        held[pages[start]] -= 1
        if not held[pages[start]]:
            del held[pages[start]]
    return out


def _range_maps(max_items: int, max_bytes: int, max_pages: int | None):
    """Of one range of a key's items and the first items of the next range: where a batch that enters at each of its first places leaves, and how many batches start on the way."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by("__rank")
        own = sum(t["__own"].to_pylist())
        ends = _next_starts([n or 0 for n in t["__size"].to_pylist()], t["__page"].to_pylist(), max_items, max_bytes, max_pages)
        leaves, starts = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            leaves[i], starts[i] = (ends[i] - own, 1) if ends[i] >= own else (leaves[ends[i]], starts[ends[i]] + 1)
        first = slice(0, max_items)
        return pa.table({"key": t["__key"].slice(0, 1), "range": t["__range"].slice(0, 1), "own": pa.array([own], pa.int64()),
                         "leaves": pa.array([leaves[first]], pa.list_(pa.int32())), "starts": pa.array([starts[first]], pa.list_(pa.int32()))})

    return run


def _entries(t):
    """The maps of a key's ranges in order, composed: where the first batch of each range starts and how many batches started before."""
    import pyarrow as pa

    t = t.sort_by("range")
    entry, number, entries, numbers = 0, 0, [], []
    for own, leaves, starts in zip(t["own"].to_pylist(), t["leaves"].to_pylist(), t["starts"].to_pylist(), strict=True):
        entries.append(entry)
        numbers.append(number)
        if entry >= own:  # the batch goes on over the whole range
            entry -= own
        else:
            entry, number = leaves[entry], number + starts[entry]
    return pa.table({"key": t["key"], "range": t["range"], "entry": pa.array(entries, pa.int32()), "number": pa.array(numbers, pa.int64())})


def _numbered(max_items: int, max_bytes: int, max_pages: int | None):
    def run(t):
        import pyarrow as pa

        t = t.sort_by("__rank")
        own, entry, number = sum(t["__own"].to_pylist()), t["entry"][0].as_py(), t["number"][0].as_py()
        ends = _next_starts([n or 0 for n in t["__size"].to_pylist()], t["__page"].to_pylist(), max_items, max_bytes, max_pages)
        out, at = [number] * min(entry, own), entry
        while at < own:
            number += 1
            out += [number] * (min(ends[at], own) - at)
            at = ends[at]
        return pa.table({"__key": t["__key"].slice(0, own), "__rank": t["__rank"].slice(0, own), "batch": pa.array(out, pa.int64())})

    return run


#: Items of a range of greedy_batches, which one task holds; longer only where a batch may be.
RANGE = 1 << 16


def greedy_batches(items: DataFrame, key: str, order_by: list[str], size_col: str, max_items: int, max_bytes: int, page_col: str | None = None,
                   max_pages: int | None = None, out: str = "batch") -> DataFrame:
    """Batches that a new item joins while count, bytes (and distinct pages) stay within limits; sums start anew with each batch.

    A batch depends on where the one before ended, but it never reaches further than
    max_items items. So each key's items are cut into ranges by their rank; for each of the
    first max_items places where a batch may enter a range, the range's map says where the
    last of its batches leaves it and how many start in it. Maps are composed in order
    (a row of a range each), and ranges number their items. No task holds a key; the order
    must be total. An item larger than the limit has a batch of its own, a null size is 0,
    items of a null key are a key of their own. Batches count from 1, as a long.
    """
    from ..sources.shared import materialize

    c = F.col
    width, length = max_items, max(RANGE, max_items)
    ranked = materialize(group_rank(items, [key], [c(x).asc() for x in order_by], "__rank"), "ranked")
    page = c(page_col).cast("string") if page_col else F.lit(None).cast("string")
    slim = ranked.select(F.to_json(F.struct(c(key).alias("k"))).alias("__key"), (c("__rank") - 1).alias("__rank"), c(size_col).cast("long").alias("__size"), page.alias("__page"))
    own = F.floor(c("__rank") / length).cast("long")
    ahead = F.when((c("__rank") % length < width) & (own > 0), F.struct((own - 1).alias("__range"), F.lit(0).alias("__own")))
    placed = slim.withColumn("p", F.explode(F.array_compact(F.array(F.struct(own.alias("__range"), F.lit(1).alias("__own")), ahead)))).select("*", "p.*").drop("p")
    maps = placed.groupBy("__key", "__range").applyInArrow(_range_maps(max_items, max_bytes, max_pages), "key string, range long, own long, leaves array<int>, starts array<int>")
    entries = materialize(maps.groupBy("key").applyInArrow(_entries, "key string, range long, entry int, number long"), "batch-entries")
    entered = placed.join(entries.select(c("key").alias("__key"), c("range").alias("__range"), "entry", "number"), ["__key", "__range"])
    numbers = entered.groupBy("__key", "__range").applyInArrow(_numbered(max_items, max_bytes, max_pages), "__key string, __rank long, batch long")
    named = ranked.withColumns({"__key": F.to_json(F.struct(c(key).alias("k"))), "__rank": c("__rank") - 1})
    return named.join(numbers.withColumnRenamed("batch", out), ["__key", "__rank"]).drop("__key", "__rank")
