"""The main body of web pages, apart from menus, notices, sidebars and footers.

Every page is rendered by layout (`functions.markup`: a tree builder with implied end
tags and visibility rules, or the lines of Markdown), so that all its visible lines
are known with their kind, block and place. No list of phrases says what is body.
Layout tells much by itself: the head of the page, what stands in navigation, aside
and footer elements, buttons, breadcrumbs, links to top-level pages. The rest is told
by how lines recur over the whole corpus, with names and numbers evened out:

* a line is a notice if it holds a sentence that recurs on many different pages, but
  hardly ever in other lines: sentences of a text stand now alone, now among others,
  those of notices always in the same line;
* a heading stands over a sidebar if it is found beside the body (before the main
  heading or in an element of that place) on a fair share of the pages that have it.

The counts are Spark aggregations over (form of sentence or heading, page): a line that stands on a
third of all pages is pre-aggregated where it is read. Their result goes back to the
pages by a join, and each page's lines are then taken or left in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.functions.markup import Line, as_text, looks_like_html, read_markdown, render, site_name
from brindle.sources.scratch import Scratch

#: What is known of a line, as bits.
HEADING, TITLE, ITEM, CELL, CONTROL, ASIDE, BEFORE, LINK, MENU, SHORT, TRAIL, OPENER, NAMED, UNDER_TITLE = (1 << k for k in range(14))
#: What is found out of a form, as bits.
NOTICE, OVER_SIDEBAR, OVER_TEXT = 1, 2, 4

_WORD = re.compile(r"[^\W\d_]+|\d+|[©›»→|·]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_TRAIL = re.compile(r"\S[^.?!]*? (?:›|»|>|→) \S")
_PART = re.compile(r"\s+[·|]\s+")
_RIGHTS = re.compile(r"©\s*\d*\s*(.+?)\.(?:\s|$)")


def form_of(text: str) -> str:
    """A text with names (words with a capital inside it) and numbers evened out, in lower case."""
    out: list[str] = []
    for k, w in enumerate(_WORD.findall(text)):
        w = "0" if w[0].isdigit() else "*" if k and w[0].isupper() else w.lower()
        if not (out and w == out[-1] and w in "*0"):
            out.append(w)
    return " ".join(out)


def _mark(form: str) -> int:
    """A form's 64-bit hash; 0 for none."""
    return xxh64_intdigest(form) - (1 << 63) if form else 0


def _depth(href: str) -> int:
    """The number of path segments of an address; fragments have none."""
    path = re.sub(r"^\w+://[^/]*", "", href.split("#", 1)[0].split("?", 1)[0])
    return len([s for s in path.split("/") if s])


def visible_lines(text: str | None) -> list[Line]:
    """The visible lines of a page, be it HTML or Markdown; none for null and blank."""
    if not text or not text.strip():
        return []
    return render(text) if looks_like_html(text) else read_markdown(text)


def described(text: str | None) -> tuple[int, list[tuple[int, int, int, int, int, list[int]]]]:
    """(page, lines): the hash of what tells the page from others, and of each line number, bits, block, form, form of its first part, forms of its sentences.

    A page is told by its main heading, a piece without one by its longest line, so
    that copies and overlapping pieces count as one.
    """
    lines = visible_lines(text)
    title = next((i for i, line in enumerate(lines) if line.kind == "h1"), -1)
    sites = {site_name(text).casefold()} - {""} if lines and looks_like_html(text) else set()
    sites |= {m.group(1).casefold() for line in lines if line.text[0] == "©" and (m := _RIGHTS.match(line.text))}
    blocks: set[int] = set()
    out = []
    for i, line in enumerate(lines):
        t, kind = line.text, line.kind
        heading, cell, link = kind[0] == "h", kind in ("row", "code"), bool(line.links) and line.link_only
        sentences = [] if heading or cell or link else _SENTENCE.split(t)
        parts = _PART.split(t) if "·" in t or "|" in t else []
        bits = HEADING * heading | TITLE * (kind == "h1") | ITEM * (kind == "li") | CELL * cell | CONTROL * (kind == "button")
        bits |= ASIDE * line.aside | BEFORE * (i < title) | UNDER_TITLE * (title >= 0) | SHORT * (len(sentences) <= 1) | OPENER * (line.block > 0 and line.block not in blocks)
        bits |= TRAIL * (kind != "code" and bool(_TRAIL.match(t))) | NAMED * (t.casefold() in sites or bool(parts) and parts[0].casefold() in sites)
        if link:
            bits |= LINK | MENU * all(_depth(h) <= 1 for _, h in line.links)
        blocks.add(line.block)
        whole = _mark(form_of(t))
        of = [whole] if len(sentences) == 1 else sorted({_mark(form_of(x)) for x in sentences})
        out.append((line.no, bits, line.block, whole, _mark(form_of(parts[0])) if len(parts) > 1 else 0, of))
    told = lines[title].text if title >= 0 else max((line.text for line in lines), key=len, default="")
    return _mark(told), out


def outlines(pages: DataFrame, text: str) -> DataFrame:
    """The other columns of `pages`, and for each text its page, no, bits, block, form and part of each line, and sentence and at (its line's place) of each sentence."""
    others = [c for c in pages.columns if c != text]
    added = "page bigint, no array<int>, bits array<int>, block array<int>, form array<bigint>, part array<bigint>, sentence array<bigint>, at array<int>"
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others] + [added])
    names = ["page", "no", "bits", "block", "form", "part", "sentence", "at"]

    def listed(rows: list[list], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), pa.array([x for r in rows for x in r], kind))

    def described_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [described(t) for t in batch.column(text).to_pylist()]
            columns = [listed([[line[k] for line in lines] for _, lines in seen], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            columns.append(listed([[x for line in lines for x in line[5]] for _, lines in seen], pa.int64()))
            columns.append(listed([[i for i, line in enumerate(lines) for _ in line[5]] for _, lines in seen], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array([p for p, _ in seen], pa.int64()), *columns], names=[*others, *names])

    return pages.mapInArrow(described_batches, schema)


def recurring_forms(outlined: DataFrame, scratch: Scratch, recurring: int = 10, mixed: float = 0.2, beside: float = 0.15) -> DataFrame:
    """(form, verdict): NOTICE, OVER_SIDEBAR and OVER_TEXT of the forms that have any.

    A notice's sentence stands on `recurring` different pages at least (on three,
    where half of its places are beside the body), and in at most `mixed` different
    lines for each place it has. A sidebar's heading has the share `beside` of its
    places beside the body.
    """
    has = lambda bits, bit: bits.bitwiseAND(F.lit(bit)) != 0
    headings = F.transform(F.filter(F.arrays_zip("form", "bits"), lambda x: has(x.bits, HEADING)), lambda x: F.struct(x.form.alias("form"), x.bits.alias("bits")))
    sentences = F.transform(F.arrays_zip("sentence", "at"), lambda x: F.struct(x.sentence.alias("form"), F.get("bits", x["at"]).alias("bits")))
    each = outlined.select("page", F.explode(F.concat(headings, sentences)).alias("x")).select("page", "x.form", "x.bits").where("form <> 0")
    heading, known, off = has(F.col("bits"), HEADING), has(F.col("bits"), UNDER_TITLE), has(F.col("bits"), UNDER_TITLE) & has(F.col("bits"), ASIDE | BEFORE)
    counted = {"n": ~heading, "known": ~heading & known, "off": ~heading & off, "h": heading, "h_known": heading & known, "h_off": heading & off}
    by_page = each.groupBy("form", "page").agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    seen = by_page.groupBy("form").agg(F.count_if(F.col("n") > 0).alias("pages"), F.count_if(F.col("h") > 0).alias("h_pages"), *[F.sum(n).alias(n) for n in counted])
    seen = scratch.keep(seen.where("pages >= 3 or h_pages >= 3"))
    often = scratch.keep(seen.where((F.col("pages") >= recurring) | (F.col("pages") >= 3) & (F.col("known") >= 3) & (F.col("off") >= 0.5 * F.col("known"))).select("form", "n"))
    few = often.count() < 200_000
    lines = outlined.select(F.explode(F.transform(F.arrays_zip("sentence", "at"), lambda x: F.struct(x.sentence.alias("form"), F.get("form", x["at"]).alias("line")))).alias("x")).select("x.form", "x.line")
    in_lines = lines.join(F.broadcast(often) if few else often, "form").groupBy("form", "line").agg(F.min("n").alias("n"))
    fixed = in_lines.groupBy("form").agg(F.count("*").alias("lines"), F.min("n").alias("of")).where(F.col("lines") <= mixed * F.col("of")).select("form", F.lit(NOTICE).alias("notice"))
    over_sidebar = F.when((F.col("h_known") >= 3) & (F.col("h_off") >= beside * F.col("h_known")), OVER_SIDEBAR).otherwise(0)
    over_text = F.when((F.col("h_pages") >= 3) & (F.col("h") * 10 >= F.col("n")), OVER_TEXT).otherwise(0)
    judged = seen.join(fixed, "form", "left").select("form", (F.coalesce("notice", F.lit(0)) + over_sidebar + over_text).alias("verdict"))
    return scratch.keep(judged.where("verdict > 0"))


def body_of(no: list[int], bits: list[int], block: list[int], form: list[int], part: list[int], sentence: list[int], at: list[int], verdict: dict[int, int]) -> list[int]:
    """The numbers of the lines of the main body, in order.

    What stands before the main heading is the head of the page. Under the heading of
    a sidebar, all of the block that the heading opens goes with it; else what follows
    up to the next heading or the first paragraph of several sentences, table or code.
    """
    out: list[int] = []
    noticed = {i for f, i in zip(sentence, at) if verdict.get(f, 0) & NOTICE}
    side, within = False, 0
    for i, (n, b, k, f, p) in enumerate(zip(no, bits, block, form, part)):
        if b & (BEFORE | ASIDE | CONTROL):
            continue
        v = verdict.get(f, 0)
        heading = b & HEADING or v & OVER_TEXT and not b & (LINK | CELL)
        if heading:
            side, within = bool(v & OVER_SIDEBAR) and not b & TITLE, k if b & OPENER else 0
            if side:
                continue
        elif side:
            if within == k if within else b & LINK or b & SHORT and not b & CELL and not (b & ITEM and not b & LINK):
                continue
            side = False
        if b & (TRAIL | MENU | NAMED) or i in noticed and not heading or p and verdict.get(p, 0) & NOTICE and not b & (CELL | HEADING):
            continue
        out.append(n)
    return out


def bodies(pages: DataFrame, keys: list[str], text: str = "text", recurring: int = 10) -> DataFrame:
    """(keys, lines): the numbers (from 0) of the lines of each page's main body.

    `keys` tell the pages apart; of repeated keys one row counts. Null, blank and
    bodiless texts give an empty list; other columns are not read. An empty table
    gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "bodies")
    parts = ["no", "bits", "block", "form", "part", "sentence", "at"]
    outlined = outlines(pages.select(*keys, F.col(text).alias("text_")), "text_")
    outlined = scratch.keep(outlined.groupBy(*keys).agg(F.max(F.struct("page", *parts)).alias("o")).select(*keys, "o.*"))
    forms = recurring_forms(outlined, scratch, recurring)
    # Forms that recur are few against lines: the size is checked before they are sent to all.
    forms = F.broadcast(forms) if forms.count() < 200_000 else forms
    asked = outlined.select(*keys, F.explode(F.array_distinct(F.concat("form", "part", "sentence"))).alias("form"))
    told = asked.join(forms, "form").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("form", "verdict"))).alias("verdict"))

    @F.pandas_udf("array<int>")
    def chosen(no: pd.Series, bits: pd.Series, block: pd.Series, form: pd.Series, part: pd.Series, sentence: pd.Series, at: pd.Series, verdict: pd.Series) -> pd.Series:
        rows = zip(no, bits, block, form, part, sentence, at, verdict)
        return pd.Series([body_of(*[x.tolist() for x in r[:7]], dict(r[7]) if r[7] is not None else {}) for r in rows], dtype=object)

    return outlined.join(told, keys, "left").select(*keys, chosen(*parts, "verdict").alias("lines"))


def body_text(text: Column, lines: Column) -> Column:
    """The rendered main body of each text, given the numbers of its lines; '' where there is none."""

    @F.pandas_udf("string")
    def rendered(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([as_text([line for line in visible_lines(t) if line.no in kept]) for t, kept in zip(texts, (set(n) if n is not None else set() for n in numbers))], dtype=object)

    return rendered(text, lines)
