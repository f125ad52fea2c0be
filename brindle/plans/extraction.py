"""From pages to validated records, with the model behind a small boundary.

A model is any object with `classify(chunk) -> list[(title, url, type)]` and
`extract(title, chunk) -> dict`. The default is a deterministic stand-in that reads
links and sentences, so that runs can be repeated without a network. Cheap filters
stand before the model stage, its output is written before it is used again, and a
chunk is keyed by its hash, so that a task run twice gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text, urls
from brindle.operators import records
from brindle.sources.scratch import Scratch

_LINK = re.compile(r'<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', re.IGNORECASE | re.DOTALL)
_SENTENCE = re.compile(r"[^.!?<>]{30,400}[.!?]")


class Model(Protocol):
    def classify(self, chunk: str) -> list[tuple[str, str, str]]: ...

    def extract(self, title: str, chunk: str) -> dict[str, str]: ...


class StandIn:
    """Links to courses, events and materials are items; their description is the chunk's first sentence."""

    KINDS = {"courses": "Course", "events": "CourseInstance", "materials": "TrainingMaterial"}

    def classify(self, chunk: str) -> list[tuple[str, str, str]]:
        found = []
        for href, anchor in _LINK.findall(chunk):
            part = next((p for p in href.split("/") if p in self.KINDS), None)
            title = re.sub(r"<[^>]*>", "", anchor).strip()
            if part and title and href.rstrip("/").rsplit("/", 1)[-1] != part:
                found.append((title, href, self.KINDS[part]))
        return found

    def extract(self, title: str, chunk: str) -> dict[str, str]:
        m = _SENTENCE.search(re.sub(r"<[^>]*>", " ", chunk))
        return {"name": title, "description": " ".join(m.group().split()) if m else ""}


def page_chunks(pages: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """(page_id, url, chunk_no, of, chunk): the pages' cleaned HTML in overlapping chunks."""
    clean = pages.where("ok and html is not null").select("page_id", "url", text.chunks(text.strip_noise(F.col("html")), size, overlap).alias("c"))
    return clean.select("page_id", "url", F.size("c").alias("of"), F.posexplode("c").alias("chunk_no", "chunk"))


def discover(chunks: DataFrame, model: Model) -> DataFrame:
    """(page_id, chunk_no, pos, title, url, item_type, description): the items that the model sees in each chunk."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, base, no, chunk in zip(b.page_id, b.url, b.chunk_no, b.chunk):
                for pos, (title, href, kind) in enumerate(model.classify(chunk)):
                    rows.append((page, base, no, pos, title, href, kind, model.extract(title, chunk).get("description", "")))
            yield pd.DataFrame(rows, columns=["page_id", "base", "chunk_no", "pos", "title", "href", "item_type", "description"])

    schema = "page_id long, base string, chunk_no int, pos int, title string, href string, item_type string, description string"
    return chunks.select("page_id", "url", "chunk_no", "chunk").mapInPandas(seen, schema)


def extract_records(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(type, id, url, name, description, conforms_to, source_page, errors): one record for each item, first seen first.

    Items are distinct by title and address; addresses are made absolute; filters of
    listings and pages without content are left out before items are kept. Blank
    descriptions become the record's name; a record is kept in any case, with what is
    wrong with it.
    """
    scratch = Scratch(pages.sparkSession, "extract")
    items = scratch.keep(discover(page_chunks(pages), model or StandIn()))
    placed = items.withColumn("url", urls.absolute(F.col("href"), F.col("base"))).where(~urls.is_non_content(F.col("url")) & ~urls.is_faceted(F.col("url"), F.col("base")))
    first = records.first_of_equals(placed, ["title", "url"], ["page_id", "chunk_no", "pos"])
    raw = first.select(
        F.col("item_type").alias("type"), records.record_id(F.lit(None).cast("string"), F.col("url"), F.col("base")).alias("id"), "url",
        F.col("title").alias("name"), F.coalesce(F.nullif("description", F.lit("")), "title").alias("description"),
        F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.col("page_id").alias("source_page"),
    )
    return raw.select("type", "id", "url", "name", "description", records.conforms_to(F.col("type")).alias("conforms_to"), "source_page", records.violations().alias("errors"))
