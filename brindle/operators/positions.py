"""Places and predecessors of rows within a group, where a group may hold a third of all rows.

A window over the group would sort it in one task. Here the rows are dealt out by
ranges of (group, order), so that a large group lies in many parts; each part numbers
its own rows, and what the parts before it hold is added from one row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.scratch import Scratch


def _dealt(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The rows with their part, and a hash of group and part by which the two are told."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn("part_", F.spark_partition_id())
    return Scratch(spark, "dealt").keep(ranged)


def _with_parts(dealt: DataFrame, parts: DataFrame, groups: list[str]) -> DataFrame:
    """Each row with what is known of its part; null groups are groups of their own."""
    renamed = parts.withColumnsRenamed({g: f"{g}_g" for g in (*groups, "part_")})
    same = F.col("part_") == F.col("part__g")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_g"))
    return dealt.join(renamed, same).drop("part__g", *[f"{g}_g" for g in groups])


def numbered(rows: DataFrame, groups: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """The rows with their place (from 1) in their group by `order`, which must be unique in it; without groups in all rows. An empty table gives an empty one."""
    dealt = _dealt(rows, groups, order)
    counted = dealt.groupBy(*groups, "part_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    parts = counted.select(*groups, "part_", F.coalesce(before, F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy(*groups, "part_").orderBy(*order))
    return _with_parts(dealt.withColumn("own_", own), parts, groups).withColumn(name, F.col("own_") + F.col("before_")).drop("own_", "before_", "part_")


def carried(rows: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the newest non-null `value` of the rows before them in their group by `order` (unique in it); null where there is none."""
    dealt = _dealt(rows.withColumn("value_", value), groups, [F.col(c) for c in order])
    last = dealt.groupBy(*groups, "part_").agg(F.max_by("value_", F.when(F.col("value_").isNotNull(), F.struct(*order))).alias("last_"))
    earlier = F.last("last_", ignorenulls=True).over(Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    parts = last.select(*groups, "part_", earlier.alias("before_"))
    own = F.last("value_", ignorenulls=True).over(Window.partitionBy(*groups, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = _with_parts(dealt.withColumn("own_", own), parts, groups)
    return joined.withColumn(name, F.coalesce("own_", "before_")).drop("own_", "before_", "part_", "value_")
