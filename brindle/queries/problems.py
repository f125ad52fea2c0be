"""Queries of the numbered general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import hierarchy, packed_values, schema_drift
from brindle.sources.tables import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields of every record, with its position."""
    results = spread(table(spark, sf_dir, "results").select("record_id", "keywords", "teaches"), "record_id")
    return packed_values.unpack(results, "record_id", {"keywords": True, "teaches": False})


def _event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf_dir, "event_log"), "run_id", "id", "parent_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every run with its root, depth, path and state."""
    return _event_trees(spark, sf_dir).select(
        F.col("g").alias("run_id"), F.col("n").alias("id"), F.col("root").alias("root_id"), "depth", "path", "state"
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair of the event trees with its distance."""
    return hierarchy.ancestor_pairs(_event_trees(spark, sf_dir)).select(
        F.col("g").alias("run_id"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), "distance"
    )


#: Fields of a summary that are single fields, whatever their keys.
WHOLE = ("crawled_page_hashes", "items_by_url")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of an export file's schema against the file before."""
    cache = spread(table(spark, sf_dir, "metadata_cache").select("id", "url", "structural_summary", "origin", "file_seq"), "id")
    return schema_drift.changes(cache, whole=WHOLE).withColumnRenamed("seq", "file_seq")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All summaries of all files under one set of field names and types."""
    cache = spread(table(spark, sf_dir, "metadata_cache").select("id", "url", "structural_summary", "origin", "file_seq"), "id")
    found = schema_drift.changes(cache, whole=WHOLE)
    one = schema_drift.consistent_table(cache, found, "structural_summary", "origin", "file_seq", "url", "id", WHOLE)
    return one.select(F.col("order").alias("id"), "origin", F.col("seq").alias("file_seq"), F.col("key").alias("url"), "field", "type", "value")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_descendants": p2_descendants, "p4_found": p4_found, "p4_table": p4_table}

_EVENTS = """e AS (SELECT run_id, id, min(parent_id) AS parent_id FROM event_log
  WHERE run_id IS NOT NULL AND id IS NOT NULL GROUP BY run_id, id),
t AS (
  SELECT run_id, id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM e
  WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM e p WHERE p.run_id = e.run_id AND p.id = e.parent_id)
  UNION ALL
  SELECT e.run_id, e.id, t.root_id, t.depth + 1, t.path || '/' || e.id FROM t JOIN e ON e.run_id = t.run_id AND e.parent_id = t.id)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_EVENTS},
u AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = e.run_id AND t.id = e.id)),
a AS (SELECT run_id, id, parent_id AS anc FROM u
  UNION SELECT a.run_id, a.id, u.parent_id FROM a JOIN u ON u.run_id = a.run_id AND u.id = a.anc)
SELECT run_id, id, root_id, CAST(depth AS INTEGER) AS depth, path, 'tree' AS state FROM t
UNION ALL
SELECT run_id, id, -1, -1, '', CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.run_id = u.run_id AND a.id = u.id AND a.anc = u.id)
  THEN 'cycle' ELSE 'under_cycle' END FROM u""",
    "p2_descendants": f"""WITH RECURSIVE {_EVENTS},
d AS (SELECT run_id, id AS descendant_id, parent_id AS ancestor_id, 1 AS distance FROM t JOIN e USING (run_id, id) WHERE depth > 0
  UNION ALL
  SELECT d.run_id, d.descendant_id, e.parent_id, d.distance + 1 FROM d JOIN e ON e.run_id = d.run_id AND e.id = d.ancestor_id
  JOIN t ON t.run_id = e.run_id AND t.id = e.id WHERE t.depth > 0)
SELECT run_id, ancestor_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM d""",
}
