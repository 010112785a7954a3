"""The given tables seen as pages of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view as doc_pages() for a SQL twin.
DOC_PAGES_SQL = """WITH doc_pages AS (
  SELECT doc_id, lang, source AS section, substring(text, 1, 40) AS title, 'doc-' || doc_id AS slug,
    '/' || lang || '/' || source || '/doc-' || doc_id || '/' AS path,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 365 AS INT) END AS published,
    CASE WHEN doc_id % 5 = 0 THEN DATE '2024-01-01' + CAST(doc_id * 7 % 400 AS INT) ELSE NULL END AS updated,
    CAST(doc_id % 50 AS BIGINT) AS weight, doc_id % 23 = 0 AS hidden, doc_id % 29 = 0 AS draft, text
  FROM documents)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: section, title, slug, path, dates, weight and flags."""
    c = F.col
    start = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", c("source").alias("section"),
        F.substring("text", 1, 40).alias("title"),
        F.concat(F.lit("doc-"), c("doc_id")).alias("slug"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/doc-"), "doc_id", F.lit("/")).alias("path"),
        F.when(c("doc_id") % 17 != 0, F.date_add(start, (c("doc_id") % 365).cast("int"))).alias("published"),
        F.when(c("doc_id") % 5 == 0, F.date_add(start, (c("doc_id") * 7 % 400).cast("int"))).alias("updated"),
        (c("doc_id") % 50).alias("weight"), (c("doc_id") % 23 == 0).alias("hidden"),
        (c("doc_id") % 29 == 0).alias("draft"), "text",
    )
