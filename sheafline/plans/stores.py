"""Files and stores: outputs written and cleaned, folders scanned and watched, state and the graph kept over runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publish
from ..sources import documents, graph_store, trees
from ..sources.adapters import table
from ..sources.shared import shared_dir
from ..streaming import watch
from .catalog import query
from .files import _cat


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: in underscored folders, with underscored names, deep ones, and hidden ones."""
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, _cat("a/_b/p", k, ".md")).when(k % 4 == 1, _cat("/_index", k, ".md")).when(k % 4 == 2, _cat("deep/1/2/3/p ", k, ".md")).otherwise(_cat(".hid/p", k, ".md"))
    kind = F.when(k % 4 == 1, "section").otherwise("page")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), path.alias("path"), F.col("text").alias("content"))


_PATH = "CASE doc_id % 4 WHEN 0 THEN 'a/_b/p' || doc_id || '.md' WHEN 1 THEN '_index' || doc_id || '.md' WHEN 2 THEN 'deep/1/2/3/p ' || doc_id || '.md' ELSE '.hid/p' || doc_id || '.md' END"


@query("written_outputs", f"""SELECT {_PATH} AS file, md5(coalesce(text, '')) AS md5, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, count(*) OVER () AS files, CAST(sum(strlen(coalesce(text, ''))) OVER () AS BIGINT) AS bytes,
  count(*) FILTER (doc_id % 4 = 1) OVER () AS sections, doc_id % 4 <> 3 AS scanned FROM documents""")
def written_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by tasks, with the counters of the pass that wrote them, listed and read again; a scan leaves out hidden ones alone."""
    folder = _folder(spark, "outputs")
    counters = publish.write_outputs(_outputs(spark, sf_dir), folder, ("page", "section"))
    there = trees.read_tree(trees.list_tree(spark, folder), folder).select("file", F.md5("content").alias("md5"), "size")
    scanned = documents.scan_files(spark, folder).select("file", F.md5("content").alias("md5"), F.lit(True).alias("scanned"))
    return there.join(scanned, ["file", "md5"], "left").select(
        "file", "md5", "size", F.lit(counters["files"]).cast("long").alias("files"), F.lit(counters["bytes"]).cast("long").alias("bytes"), F.lit(counters["section"]).cast("long").alias("sections"), F.coalesce("scanned", F.lit(False)).alias("scanned"))


@query("cleaned_outputs", f"SELECT {_PATH} AS file, doc_id % 4 = 3 AS hidden FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 3")
def cleaned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up leaves: the files that are planned, and hidden ones."""
    folder, rows = _folder(spark, "outputs"), _outputs(spark, sf_dir)
    publish.write_outputs(rows.select("path", "content"), folder)
    publish.clean_outputs(spark, folder, rows.where("doc_id % 3 = 0").select("path"))
    return trees.list_tree(spark, folder).select("file", F.col("file").startswith(".").alias("hidden"))


@query("watched_changes", """SELECT 1 AS version, '/content/p' || doc_id || '.md' AS path, 'create' AS raw FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 2, '/content/p' || doc_id || '.md', CASE WHEN doc_id % 7 = 0 THEN 'create' WHEN doc_id % 5 = 1 THEN 'remove' ELSE 'modify' END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 1 OR doc_id % 3 = 0""")
def watched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder watched by two runs of one stream, with files made, changed and removed between them."""
    site, name = _folder(spark, "site"), _folder(spark, "watched")
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", _cat("content/p", k, ".md").alias("path"), F.col("text").alias("content"))

    def look() -> None:
        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{name}/rows/batch={batch}")

        stream = watch.watch(spark, site, f"{name}/state")
        watch.wait(stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{name}/checkpoint").start())

    publish.write_outputs(files.where("doc_id % 7 <> 0"), site)
    look()
    publish.write_outputs(files.where("doc_id % 7 = 0 OR (doc_id % 3 = 0 AND doc_id % 5 <> 1)").withColumn("content", _cat(F.coalesce("content", F.lit("")), " changed")), site)
    publish.clean_outputs(spark, site, files.where("doc_id % 7 = 0 OR doc_id % 5 <> 1"))
    look()
    return spark.read.schema("version long, path string, raw string").parquet(f"{name}/rows/batch=*").select(F.col("version").cast("int").alias("version"), "path", "raw")


@query("stored_graph", """SELECT 'pages' AS name, '/d' || doc_id || '/' AS id, lang AS value, true AS migrated FROM documents UNION ALL SELECT 'topics', 't' || p_partkey, p_name, true FROM part
UNION ALL SELECT 'relations', 't' || l_partkey, 's' || l_suppkey, true FROM lineitem UNION ALL SELECT 'claims', 'c' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://example.org/' || s_suppkey END, true FROM supplier""")
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph saved and loaded again, empty tables too, and whether it was filled from this site."""
    folder = _folder(spark, "graph")
    k = F.col("s_suppkey")
    graph_store.save({
        "pages": table(spark, sf_dir, "documents").select(_cat("/d", F.col("doc_id"), "/").alias("id"), "lang", F.array(F.lit("Article")).alias("schema_types")),
        "topics": table(spark, sf_dir, "part").select(_cat("t", F.col("p_partkey")).alias("id"), F.col("p_name").alias("label")),
        "relations": table(spark, sf_dir, "lineitem").select(_cat("t", F.col("l_partkey")).alias("from"), _cat("s", F.col("l_suppkey")).alias("to"), F.lit("about").alias("kind")),
        "claims": table(spark, sf_dir, "supplier").select(_cat("c", k).alias("id"), F.when(k % 2 == 0, _cat("https://example.org/", k)).alias("evidence_url"), F.lit(True).alias("allows_aggregate_rating")),
        "meta": table(spark, sf_dir, "region").agg(F.lit(graph_store.VERSION).alias("version"), F.lit("https://example.org").alias("origin"), F.max(F.lit("now")).alias("updated")),
    }, folder)
    back = graph_store.load(spark, folder)
    there = graph_store.migrated_for(back["meta"], "https://example.org") and not graph_store.migrated_for(back["meta"], "https://other.org") and back["persons"].isEmpty()
    parts = [back["pages"].select(F.lit("pages").alias("name"), "id", F.col("lang").alias("value")), back["topics"].select(F.lit("topics"), "id", "label"), back["relations"].select(F.lit("relations"), "from", "to"), back["claims"].select(F.lit("claims"), "id", "evidence_url")]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return out.withColumn("migrated", F.lit(there))
