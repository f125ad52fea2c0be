"""Reading the input tables and spreading them over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; columns are pruned by what follows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work before a stage of heavy Python, where the scan alone would not.

    A scan of few large files (or a file of one row group) has fewer partitions than
    the cluster has cores; only then are the rows shuffled, by a hash of `keys`.
    With no keys the rows are dealt round-robin.
    """
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    n = max(cores * 2, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(k) for k in keys])
