"""Queries of the numbered problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import boilerplate, leakage, pairs, subjects, tokenization, truncation
from brindle.sources.tables import spread, table


PREVIEWS = ["prompt_preview", "response_preview", "chunk_preview"]


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_log").where(F.col("type") == "llm_call")


def _cut_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spread(_calls(spark, sf_dir).select("run_id", "id", "source", *PREVIEWS), "run_id", "id")
    return truncation.cut_texts(calls, PREVIEWS, ["chunk_preview"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preview text of a model call that was cut off."""
    return _cut_previews(spark, sf_dir).where("cut").select("run_id", "id", "field")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each preview field."""
    return (
        _cut_previews(spark, sf_dir)
        .groupBy("source", "field")
        .agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"))
        .withColumn("rate", F.round(F.col("cut_texts") / F.col("texts"), 4))
    )


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage limits of each source and field: the measure, the length and how many different texts end there."""
    calls = spread(_calls(spark, sf_dir).select("run_id", "id", "source", *PREVIEWS), "run_id", "id")
    found = truncation.limits(truncation.judged_texts(calls, PREVIEWS, ["chunk_preview"]))
    names = F.array(*[F.lit(m) for m in truncation.MEASURES])
    return found.select("source", "field", F.get(names, F.col("m")).alias("measure"), "size", "texts")


def _shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, record_key, text) of every fetched page and every page text given to a model."""
    pages = table(spark, sf_dir, "pages").where("ok").select(F.lit("pages").alias("origin"), F.col("page_id").cast("string").alias("record_key"), F.col("html").alias("text"))
    calls = _calls(spark, sf_dir).where("chunk_preview <> ''")
    given = calls.select(F.lit("event_log").alias("origin"), F.concat_ws("/", "run_id", F.col("id").cast("string")).alias("record_key"), F.col("chunk_preview").alias("text"))
    return spread(pages, "record_key").unionByName(spread(given, "record_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the main body in every fetched page and every page text given to a model."""
    return boilerplate.bodies(_shown_texts(spark, sf_dir), ["origin", "record_key"]).select("origin", "record_key", F.explode("lines").alias("line_no"))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered main body of every fetched page; what recurs is counted over all pages and page texts."""
    found = boilerplate.bodies(_shown_texts(spark, sf_dir), ["origin", "record_key"]).where("origin = 'pages'").select(F.col("record_key").cast("long").alias("page_id"), "lines")
    pages = table(spark, sf_dir, "pages").where("ok").select("page_id", "html")
    return pages.join(found, "page_id").select("page_id", boilerplate.body_text(F.col("html"), F.col("lines")).alias("body"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken pair of prompt and response with the kind of its defect."""
    calls = spread(_calls(spark, sf_dir).select("run_id", "id", "source", "task", "prompt_preview", "response_preview"), "run_id", "id")
    return pairs.defects(calls)


def p6_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of each task and model have each defect."""
    calls = _calls(spark, sf_dir).select("run_id", "id", "task", "model").dropDuplicates(["run_id", "id"])
    return p6_found(spark, sf_dir).join(calls, ["run_id", "id"]).groupBy("task", "model", "defect").agg(F.count("*").alias("pairs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return tokenization.encode_column(documents, "doc_id", "text", f"{tokenization.VOCABULARIES}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each test item that it leaks."""
    return p8_stretches(spark, sf_dir).select("doc_id", "item_id")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest stretch of each leaked item in each document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return leakage.leaks(documents, table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject area that each document treats."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return subjects.subject_areas(documents, table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of documents and of characters of each subject."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    treated = p9_found(spark, sf_dir).join(documents, "doc_id")
    return treated.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p3_limits": p3_limits, "p5_found": p5_found, "p5_texts": p5_texts, "p6_found": p6_found, "p6_by_task": p6_by_task, "p7_ids": p7_ids, "p8_found": p8_found, "p8_stretches": p8_stretches, "p9_found": p9_found, "p9_composition": p9_composition}

SQL: dict = {}
