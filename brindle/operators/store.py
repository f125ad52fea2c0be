"""Keyed tables of sessions and cache rows: newest rows, merges, guarded changes.

Parquet tables have no row-level updates: a change is a DataFrame that replaces the
table, built from keyed aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import positions

#: The tables of users, sessions and cache rows.
TABLES = {
    "users": "id BIGINT, token_hash STRING, created_at TIMESTAMP, is_admin BOOLEAN",
    "sessions": "id BIGINT, user_id BIGINT, url STRING, status STRING, log STRING, result_json STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "metadata_cache": "id BIGINT, url STRING, content_hash STRING, structural_summary STRING, last_crawled_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """Creates the database and its tables where they are missing; what is there stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def look_up(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted keys; a wanted key that is missing has no row. A single literal key is a filter that reaches the scan."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """The rows that have the wanted values; a wanted value of None is no condition."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def inserted(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, user_id, url, status): a pending session for each (user_id, url) asked for, its ids following the greatest one."""
    last = sessions.agg(F.max("id")).first()[0] or 0
    new = positions.numbered(asked.select("user_id", "url").distinct(), [], [F.col("user_id"), F.col("url")])
    return new.select((F.lit(last) + F.col("n")).alias("id"), "user_id", "url", F.lit("pending").alias("status"))


def coalesced(rows: DataFrame, updates: DataFrame, key: str, fields: list[str], touched: str) -> DataFrame:
    """`rows` with the given values of `updates` (one row for each key) put in; nulls keep what is there, `touched` becomes the update's own."""
    joined = rows.alias("r").join(updates.select(key, touched, *fields).alias("u"), key, "left")
    return joined.select(key, *[F.coalesce(f"u.{c}", f"r.{c}").alias(c) if c in (*fields, touched) else F.col(f"r.{c}") for c in rows.columns if c != key])


def revoked(users: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The users that none of the identifiers (ids, hashes of tokens or tokens) names."""
    kind = identifier_kind(F.col("identifier"))
    named = identifiers.where("identifier is not null").select(kind.alias("kind"), "identifier")
    ids = named.where("kind = 'id'").select(F.col("identifier").try_cast("bigint").alias("id"))
    hashes = named.where("kind <> 'id'").select(F.when(F.col("kind") == "hash", F.col("identifier")).otherwise(F.sha2("identifier", 256)).alias("token_hash"))
    return users.join(ids, "id", "left_anti").join(hashes, "token_hash", "left_anti").select(*users.columns)


def newest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the greatest order; partial aggregation makes hot keys cheap. Ties must be broken by `order`."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row_")).select(*keys, "row_.*")


def merge_versions(rows: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """One row for each key: of every field the newest value that isn't null, as successive upserts would leave it."""
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` put in by key: given values replace, nulls keep what was there."""
    fields = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f) if f in new.columns else F.col(f"o.{f}") for f in fields])


def append_line(log: Column, line: Column) -> Column:
    """A log with one more line; a null log becomes the line."""
    return F.concat_ws("\n", log, line)


def cancelled(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """The sessions, and whether each is `affected`: one that waits or runs and that its own user (user_id, id in `asked`) cancels."""
    mine = asked.select("user_id", "id").distinct().withColumn("mine", F.lit(True))
    joined = sessions.join(mine, ["user_id", "id"], "left")
    affected = F.coalesce("mine", F.lit(False)) & F.col("status").isin("pending", "running")
    return joined.withColumn("affected", affected).withColumn("status", F.when(affected, "cancelled").otherwise(F.col("status"))).drop("mine")


def is_empty_log(log: Column) -> Column:
    """Null, empty and the empty JSON array; a log that is no JSON isn't empty."""
    return log.isNull() | (F.trim(log) == "") | (F.json_array_length(log) == 0)


def waiting(sessions: DataFrame) -> DataFrame:
    """The sessions to take up with their place in the queue, oldest first: waiting ones, and running ones that never wrote a log."""
    queue = sessions.where((F.col("status") == "pending") | ((F.col("status") == "running") & F.coalesce(is_empty_log(F.col("log")), F.lit(False))))
    return positions.numbered(queue, [], [F.col("id")], "place")


def identifier_kind(identifier: Column) -> Column:
    """Whether a user's identifier is an id, a token's hash or a token."""
    return F.when(identifier.rlike("^[0-9]+$"), "id").when(identifier.rlike("^[0-9a-f]{64}$"), "hash").otherwise("token")
