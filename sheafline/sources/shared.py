"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a URI; without one, a temporary one in local mode and an error on a cluster, whose machines do not share theirs.

    A path without a scheme is one of Hadoop's default file system, as Spark itself takes it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="sheafline-")
        spark.sparkContext.setCheckpointDir(named)
    place = spark._jvm.org.apache.hadoop.fs.Path(named)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", whole).rstrip("/")


def join_shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left.join(right) with both sides dealt by their keys, for sides that grow with the input.

    What is written well packed, as answers that repeat are, seems small by its files; Spark
    would send it whole through the driver, where its rows are many times as large.
    """
    return left.join(right.hint("merge"), on, how)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts lineage and fixes the rows: later reads see the same rows and ids even when
    executors are lost. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
