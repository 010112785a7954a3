"""The graph as tables on disk: seven of them, versioned, with an upgrade of the first version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = 2
SCHEMAS = {
    "pages": "id string, canonical_path string, path string, title string, h1 string, summary string, lang string, translation_of string, author string, date_published string, date_modified string, og_image string, "
             "schema_types array<string>, content_hash string, enriched_hash string, word_count int, stub boolean, thin boolean, noindex boolean, sitemap boolean",
    "topics": "id string, label string", "relations": "`from` string, `to` string, kind string", "persons": "id string, name string, url string",
    "organizations": "id string, name string, url string, logo string, same_as array<string>",
    "claims": "id string, page string, metric string, value string, evidence_url string, allows_aggregate_rating boolean", "meta": "version int, origin string, updated string",
}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables; one that isn't there or holds nothing is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    out = {}
    for name, schema in SCHEMAS.items():
        place = fs_path(f"{folder}/{name}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        out[name] = spark.read.schema(schema).json(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
    return out


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the given tables as JSON lines; a table is replaced as a whole."""
    for name, df in tables.items():
        columns = [f.name for f in df.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields]
        df.select(*[f"`{c}`" for c in columns if c in df.columns]).write.mode("overwrite").json(f"{folder}/{name}")


def migrated_for(meta: DataFrame, origin: str) -> bool:
    """Whether the store was already filled from this site."""
    return not meta.where(meta.origin == origin).limit(1).isEmpty()
