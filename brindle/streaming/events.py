"""Run logs as a stream: windowed counts with late rows, and the newest state of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import store


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, at: str = "ingested_at", late: str = "2 days", width: str = "1 hour") -> DataFrame:
    """(start, type, events): events of each kind in windows of time; rows later than `late` are left out, rows delivered twice count once."""
    timed = events.withWatermark(at, late).dropDuplicatesWithinWatermark(["run_id", "id"])
    counted = timed.groupBy(F.window(at, width).alias("w"), "type").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), "type", "events")


def _kept(spark: SparkSession, target: str) -> dict[tuple[int, int], str]:
    """(bucket, version) of every folder of a table that `keep_newest` keeps, with its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/bucket=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    places = [status.getPath().toString() for status in found]
    return {(int(p.rsplit("bucket=", 1)[1]), int(p.rsplit("v=", 1)[1].split("/")[0])): p for p in places}


def read_newest(spark: SparkSession, target: str, schema: T.StructType | str) -> DataFrame:
    """The table that `keep_newest` keeps: the newest version of every bucket."""
    kept = _kept(spark, target)
    newest = {b: max(v for c, v in kept if c == b) for b, _ in kept}
    return spark.read.schema(schema).parquet(*[kept[b, v] for b, v in newest.items()])


def keep_newest(target: str, key: str = "run_id", order: str = "timestamp", buckets: int = 64):
    """A foreachBatch function that keeps the newest row of each key in a Parquet table, in buckets by the key's hash.

    A batch writes only the buckets that it touches, as its own version made from the
    version before, so that a batch run again after a failure gives the same table.
    Versions older than the one before are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in bucketed.select("bucket").distinct().collect()}  # at most `buckets`
        kept = _kept(spark, target)
        before = {b: max((v for c, v in kept if c == b and v < number), default=None) for b in touched}
        old = [kept[b, v] for b, v in before.items() if v is not None]
        rows = bucketed
        if old:
            past = spark.read.schema(batch.schema).parquet(*old)
            rows = rows.unionByName(past.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        newest = store.newest(rows, [key], F.struct(order, "id"))
        newest.select(*batch.columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        for (b, v), path in kept.items():
            if b in touched and before[b] is not None and v < before[b]:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return write
