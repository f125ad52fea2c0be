"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where none is set on one machine, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="brindle-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application; results that aren't written yet can no longer be read.

    It is done without being asked when Python ends with the session still alive. A
    job that runs many queries calls it after each result is written.
    """
    _delete(spark, _folder(spark))


def _release_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the session ended before: nothing is left to ask
        pass


class Scratch:
    """Written tables of one run of an iterative operator.

    Each `keep` writes a DataFrame as Parquet and returns the table read back: the
    lineage is cut, the files survive the loss of an executor, and later readers
    prune columns. `drop` deletes a kept table that no later step reads; `release`
    deletes what is left once the results are written.
    """

    _registered = False

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        if not Scratch._registered:
            Scratch._registered = True
            atexit.register(_release_at_exit)

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.__dict__["scratch_path"] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes kept tables; a DataFrame that isn't one itself is left alone."""
        for df in tables:
            if path := df.__dict__.pop("scratch_path", None):
                _delete(self.spark, path)
