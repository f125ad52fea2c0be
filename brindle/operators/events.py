"""Run logs: summaries by run and task, display lines, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import positions


def once(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each event (run_id, id) once; of rows delivered again the one taken in first, by ingested_at."""
    names = [c for c in columns if c not in ("run_id", "id")]
    return events.groupBy("run_id", "id").agg(F.min_by(F.struct(*names), "ingested_at").alias("e")).select("run_id", "id", "e.*")


def _is(kind: str) -> Column:
    return F.col("type") == kind


def run_summary(events: DataFrame) -> DataFrame:
    """The counts and sums of each run."""
    return events.groupBy("run_id").agg(
        F.count_if(_is("llm_call")).alias("llm_calls"),
        F.round(F.coalesce(F.sum(F.when(_is("llm_call"), F.col("latency_ms"))), F.lit(0.0)), 1).alias("total_llm_ms"),
        F.count_if(_is("fetch")).alias("fetches"),
        F.count_if(_is("item_found")).alias("items_found"),
        F.count_if(_is("validation")).alias("validations"),
        F.coalesce(F.sum(F.when(_is("validation"), F.size(F.coalesce("errors", F.array())))), F.lit(0)).cast("long").alias("validation_errors"),
        F.count_if(_is("validation") & ~F.col("passed")).alias("failed_validations"),
        F.count_if(_is("warn")).alias("warnings"),
    )


def task_summary(events: DataFrame) -> DataFrame:
    """Calls and milliseconds of each run's tasks."""
    calls = events.where(_is("llm_call"))
    return calls.groupBy("run_id", "task").agg(F.count("*").alias("calls"), F.round(F.sum("latency_ms"), 1).alias("total_ms"))


def checkpoints(events: DataFrame, first: int = 3, every: int = 10) -> DataFrame:
    """(run_id, id, n): the events at which a run's log is written: each of the first ones, then every tenth."""
    n = positions.numbered(events.select("run_id", "id"), ["run_id"], [F.col("id")])
    return n.where((F.col("n") <= first) | (F.col("n") % every == 0))


def display_line() -> Column:
    """One line for each kind of event."""
    errors = F.size(F.coalesce("errors", F.array()))
    noted = F.when(errors > 0, F.format_string(" – %d error(s)", errors)).otherwise("")
    return (
        F.when(_is("info"), F.col("message"))
        .when(_is("warn"), F.concat(F.lit("! "), "message"))
        .when(_is("llm_call"), F.concat(F.lit("[LLM:"), "task", F.lit("] "), F.round("latency_ms").cast("long").cast("string"), F.lit(" ms")))
        .when(_is("fetch"), F.concat(F.lit("< "), "url", F.lit(" ["), F.col("status_code").cast("string"), F.lit("]")))
        .when(_is("item_found"), F.concat(F.lit("* "), "title", F.lit(" ("), "item_type", F.lit(")")))
        .when(_is("validation"), F.concat(F.when(F.col("passed"), "ok ").otherwise("not ok "), "item_name", noted))
    )


def joined_texts(events: DataFrame, text: str, limit: int, separator: str = "\n\n---\n\n") -> DataFrame:
    """(run_id, parts, joined): each run's texts in order, as many whole ones as fit into `limit` characters; else the first one cut.

    A text takes at least one character, so no run needs more than its first `limit`
    texts: the rank filter prunes every run before it is shuffled.
    """
    order = Window.partitionBy("run_id").orderBy("id")
    given = events.where(F.length(text) > 0).select("run_id", "id", F.col(text).alias("t"))
    first = given.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    used = F.sum(F.length("t") + F.when(F.col("n") > 1, len(separator)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fitting = first.withColumn("used", used).where((F.col("used") <= limit) | (F.col("n") == 1))
    parts = F.array_sort(F.collect_list(F.struct("n", "t")))
    return fitting.groupBy("run_id").agg(F.count("*").alias("parts"), F.left(F.array_join(F.transform(parts, lambda p: p.t), separator), F.lit(limit)).alias("joined"))
