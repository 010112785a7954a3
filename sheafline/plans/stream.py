"""The events table read as a stream of file changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table
from ..sources.shared import shared_dir
from ..streaming import changes, watch
from .catalog import query

#: Events as changes: views modify content, carts create templates, purchases remove static files, others touch the config or a temporary file.
_CHANGES = """WITH c AS (SELECT ts, event_id, CASE event_type WHEN 'view' THEN '/content/p' || user_id || '.md' WHEN 'click' THEN '/templates/t' || user_id % 50 || '.html' WHEN 'purchase' THEN '/static/s' || user_id || '.png' WHEN 'signup' THEN '/config.toml' ELSE '/content/p' || user_id || '.md~' END AS path,
  CASE WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 5 = 1 THEN 'create' WHEN event_id % 5 = 2 THEN NULL ELSE 'modify' END AS kind FROM events)
, l AS (SELECT path, arg_max(kind, ts) AS kind FROM c WHERE kind IS NOT NULL AND NOT ends_with(path, '~') GROUP BY path)
, k AS (SELECT path, kind, CASE WHEN starts_with(path, '/content') THEN 'content' WHEN starts_with(path, '/templates') THEN 'templates' WHEN starts_with(path, '/static') THEN 'static' ELSE 'config' END AS change_kind FROM l)
"""


def _changes(events: DataFrame) -> DataFrame:
    c = F.col
    path = (F.when(c("event_type") == "view", F.concat(F.lit("/content/p"), "user_id", F.lit(".md"))).when(c("event_type") == "click", F.concat(F.lit("/templates/t"), c("user_id") % 50, F.lit(".html")))
            .when(c("event_type") == "purchase", F.concat(F.lit("/static/s"), "user_id", F.lit(".png"))).when(c("event_type") == "signup", "/config.toml").otherwise(F.concat(F.lit("/content/p"), "user_id", F.lit(".md~"))))
    raw = F.element_at(F.array(*map(F.lit, ("remove", "create", "access", "modify.data", "modify"))), (c("event_id") % 5 + 1).cast("int"))
    return events.select("ts", path.alias("path"), raw.alias("raw"))


@query("stream_last_change", _CHANGES + "SELECT path, kind, change_kind FROM k")
def stream_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the table's files as a stream until none is left; executors write each batch's last changes to the shared folder, and the last of each path are taken from there."""
    place = f"{sf_dir}/events.parquet"
    stream = changes.stream_table(spark, place, table(spark, sf_dir, "events").schema)
    name = f"{shared_dir(spark)}/last-change-{uuid.uuid4().hex}"

    def write(last: DataFrame, n: int) -> None:
        last.write.mode("overwrite").parquet(f"{name}/batch={n}")  # a batch that is run again replaces its own rows

    changes.apply_stream(_changes(stream), write, f"{name}-checkpoint").awaitTermination()
    schema = changes.last_changes(changes.meaningful(_changes(table(spark, sf_dir, "events")))).schema
    rows = spark.read.schema(schema).parquet(f"{name}/batch=*") if changes.has_files(spark, name) else spark.createDataFrame([], schema)
    return rows.groupBy("path").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.first("change_kind").alias("change_kind"))


@query("served_versions", _CHANGES + "SELECT path, kind, change_kind FROM k WHERE kind <> 'remove'")
def served_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is served after all changes of a stream: the state table's last version."""
    name = f"{shared_dir(spark)}/served-{uuid.uuid4().hex}"
    served = watch.StateTable(spark, f"{name}/state", "path string, kind string, change_kind string, ts timestamp", "path")

    def keep(last: DataFrame, batch: int) -> None:
        # an event may come after a later one: what is kept tells whether it counts
        old = served.read(before=batch).select("path", F.col("ts").alias("kept"))
        new = last.join(old, "path", "left").where("kept IS NULL OR ts >= kept").drop("kept").select("path", "kind", "change_kind", "ts")
        served.apply(new, new.limit(0), batch)

    stream = changes.stream_table(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    changes.apply_stream(_changes(stream), keep, f"{name}/checkpoint").awaitTermination()
    return served.read().where("kind <> 'remove'").select("path", "kind", "change_kind")


@query("rebuild_plan", _CHANGES + "SELECT change_kind, count(*) AS n, CASE WHEN change_kind = 'config' OR (change_kind = 'content' AND bool_or(kind = 'remove')) THEN 'full' WHEN change_kind = 'static' THEN 'copy' ELSE 'partial' END AS action FROM k GROUP BY change_kind")
def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rebuild_plan(changes.last_changes(changes.meaningful(_changes(table(spark, sf_dir, "events")))))
