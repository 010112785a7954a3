"""File changes as a stream: normalised, reduced to the last one of each path, classified, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a change is by the first step of its path, in the order of tests.
KINDS = (("/templates", "templates"), ("/themes", "themes"), ("/content", "content"), ("/static", "static"), ("/sass", "sass"))
_TEMPORARY = r"(?i)(^|/)(\.[^/]*|#[^/]*#|[^/]*~|[^/]*\.(swp|swx|tmp|bck|bak|kate-swp))$|jb_(tmp|old)___$|(^|/)4913$"


def event_kind(raw: Column) -> Column:
    """create, modify or remove of a watcher's event name; null for those that change nothing."""
    name = F.lower(raw)
    return (F.when(name.startswith("create"), "create").when(name.startswith("remove") | name.startswith("delete"), "remove")
            .when(name.isin("modify", "modify.data", "modify.metadata.write_time", "modify.metadata.permissions", "modify.metadata.ownership", "modify.name.to", "modify.name.any"), "modify"))


def is_temporary(path: Column) -> Column:
    return path.rlike(_TEMPORARY)


def change_kind(path: Column, config: str = "/config.toml") -> Column:
    """The kind of a change from its path below the root: content is tested before the config file, anything else is an extra path."""
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    out = F.when(p == config, "config").otherwise("extra")
    for prefix, kind in reversed(KINDS):
        out = F.when((p == prefix) | p.startswith(prefix + "/"), kind).otherwise(out)
    return out


def meaningful(events: DataFrame, config: str = "/config.toml", ignored: str | None = None) -> DataFrame:
    """events (ts, path, raw) that matter: a known kind, no temporary file, not ignored, no plain file beside the config."""
    out = events.withColumn("kind", event_kind(F.col("raw"))).where("kind IS NOT NULL").where(~is_temporary(F.col("path")))
    beside = F.col("path").rlike("^/?[^/]+$") & (F.col("path") != config) & (F.concat(F.lit("/"), "path") != config)
    out = out.where(~beside)
    return out.where(~F.col("path").rlike(ignored)) if ignored else out


def last_changes(events: DataFrame, config: str = "/config.toml") -> DataFrame:
    """(path, kind, change_kind, ts): each path's last event; one aggregation, so it works on a stream as well."""
    last = F.max_by("kind", F.struct("ts", "kind"))
    return events.groupBy("path").agg(last.alias("kind"), F.max("ts").alias("ts")).withColumn("change_kind", change_kind(F.col("path"), config))


def rebuild_plan(changes: DataFrame) -> DataFrame:
    """(change_kind, n, action): what each kind of change asks for. Templates and content are rebuilt in part, config and themes in full."""
    action = (F.when(F.col("change_kind").isin("config", "themes"), "full").when((F.col("change_kind") == "content") & F.col("removed"), "full")
              .when(F.col("change_kind") == "static", "copy").when(F.col("change_kind") == "sass", "compile").otherwise("partial"))
    by = changes.groupBy("change_kind").agg(F.count("*").alias("n"), F.max(F.col("kind") == "remove").alias("removed"))
    return by.select("change_kind", "n", action.alias("action"))


def upsert(state: DataFrame, rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """state with rows put in by key and removed keys taken out: anti joins and a union."""
    gone = rows.select(key).unionByName(removed.select(key)).distinct()
    return state.join(gone, key, "left_anti").unionByName(rows)


def apply_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "1 second"):
    """Runs apply(last changes of the batch, batch id) for each micro-batch; `once` works off what is there and ends."""

    def batch(df: DataFrame, n: int) -> None:
        apply(last_changes(meaningful(df)), n)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table's files as a stream, oldest first. The path is given as a pattern, so it may be one file as well as a folder."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there: a stream without rows writes none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
