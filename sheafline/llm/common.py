"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir

__all__ = ["dealt", "discard", "hash_sample", "held_out", "join_hot", "materialize", "renamed", "shared_dir"]

#: Session setting: into how many partitions dealt() deals a table. Unset, tables stay as they are read.
PARTITIONS = "spark.sheafline.partitions"


def discard(df: DataFrame) -> None:
    """Removes the files of a materialize() result that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def dealt(df: DataFrame) -> DataFrame:
    """df in the number of partitions that the session asks for, whatever its size; as it is read where it asks for none.

    For tables that lie in fewer row groups than the cluster has cores.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 and so on, and what each name of df has become: no name of the caller's can clash then.

    Of columns with the same name, the first one is found.
    """
    names: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        names.setdefault(name, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), names


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_sample(df: DataFrame, n: int, *, by: list[str], group: str | None = None) -> DataFrame:
    """Of each group, or of all of df, the n rows with the smallest hashes of the columns `by`; all of a group that has fewer.

    Rows that are equal in `by` are one row. Every group has its rows, however many
    groups there are and however many copies one holds, and they are the same rows
    however df is partitioned. A counting pass tells which hashes can be among the
    smallest, so only some 4n hashes of a group meet; rows with a null group are left out.
    """
    c = F.col
    cols = df.columns
    hashed = df.withColumn("__h", F.xxhash64(*by, F.lit("sample")).bitwiseAND(F.lit((1 << 62) - 1)))
    count, most = F.approx_count_distinct("__h").alias("__n"), 4.0 * n + 100
    share = c("__h") / float(1 << 62)
    if group is None:
        total = max(1, hashed.agg(count).first()[0])
        keys = ["__h"]
        picked = hashed.where(share < most / total).select("__h").distinct().orderBy("__h").limit(n)
    else:
        keys = [group, "__h"]
        hashed = hashed.where(c(group).isNotNull())
        sizes = materialize(hashed.groupBy(group).agg(count), "group-sizes")
        small = hashed.select(*keys).join(sizes, group).where(share < F.lit(most) / c("__n")).select(*keys).distinct()
        picked = small.selectExpr("*", f"row_number() OVER (PARTITION BY `{group}` ORDER BY __h) AS __r").where(c("__r") <= n).select(*keys)
    rows = hashed.join(materialize(picked, "picked"), keys)
    return rows.groupBy(*keys).agg(F.first(F.struct(*cols)).alias("__row")).select("__row.*")


def join_hot(many: DataFrame, few: DataFrame, key: str, *, by: str, share: int = 4096) -> DataFrame:
    """Inner join of many with few, whose keys are distinct; keys that hold over 1/share of many's rows are dealt over salts of the column `by`.

    At most `share` keys can hold so much, so what is broadcast is bounded, and all
    their copies in few are 2 * share rows at most.
    """
    c = F.col
    counts = materialize(many.groupBy(key).count(), "key-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(c("count") * share > total).select(key, F.ceil(c("count") * share / F.lit(max(total, 1))).cast("int").alias("__n"))
    salted = many.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(c("__n").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), c("__n"))).cast("int"))
    copies = few.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__n")
    return salted.drop("__n").join(copies, [key, "__salt"]).drop("__salt")
