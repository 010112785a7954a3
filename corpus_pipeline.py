"""Documents to packed training sequences, stage by stage.

Each stage reads all that its predecessor kept; all but the last return the columns
of documents. A runner may write each result as Parquet and hand it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import linequality, packing, rules, similar
from sheafline.llm.common import dealt, materialize, renamed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a base rule or are mostly boilerplate lines.

    Null, empty and blank texts fail. Rows are judged one by one, so repeated rows and
    ties share their fate and an empty table gives an empty one; columns of docs come out
    as they are, whatever their names.
    """
    field = linequality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, names = renamed(docs)
    return linequality.with_line_quality(inner, field, text_col=names["text"]).where("kept").select(*inner.columns).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores below its cutoff; it learns from the whole table, as the stages before leave few bad examples or none.

    Null and empty texts are scored like any other. Rows are judged one by one, so
    repeated rows and ties share their fate and an empty table gives an empty one;
    columns of docs come out as they are, whatever their names.
    """
    model = rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, names = renamed(docs)
    return rules.with_scores(inner, model, text_col=names["text"]).where("predicted = 1").select(*inner.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return similar.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: one row per piece, with its token ids."""
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("packing", pack),
]

#: Learned models, fingerprints and tokens are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
