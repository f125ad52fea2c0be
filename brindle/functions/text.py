"""Texts as Column expressions: noise, hashes, excerpts, tolerant parsing, chunks."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of a page.
NOISE = ("script", "style", "noscript", "template")


def strip_noise(html: Column) -> Column:
    """HTML without scripts, styles and other content that isn't shown."""
    for tag in NOISE:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return html


def plain_text(html: Column) -> Column:
    """The text of HTML: noise and tags taken out, white space squeezed."""
    bare = F.regexp_replace(strip_noise(html), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def head_and_tail(text: Column, limit: int = 6000, half: int = 3000, marker: str = "\n[...]\n") -> Column:
    """A long text's first and last `half` characters around a marker; a short one as it is."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def tolerant_json(text: Column) -> Column:
    """A VARIANT of the text, else of the longest braced part in it, else of an empty object."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)), F.try_parse_json(F.lit("{}")))


def probability(text: Column, default: float = 0.01) -> Column:
    """A number between 0 and 1; what is no number gives the default."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(text.try_cast("double"), F.lit(default))))


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


#: What a chunk preferably ends before, else behind, in this order.
PARAGRAPH = "\n\n"
SENTENCE_ENDS = (". ", ".\n", "? ", "! ")


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text longer than `size`.

    Every place where a chunk may end is found first, for the whole text; each window
    then takes its last paragraph, else the last end of the first kind of sentence
    end that it has past its middle, else all of it.
    """
    kinds = [[m.start() for m in re.finditer(f"(?={re.escape(PARAGRAPH)})", text)]]
    kinds += [[m.start() for m in re.finditer(f"(?={re.escape(end)})", text)] for end in SENTENCE_ENDS]
    marks = [PARAGRAPH, *SENTENCE_ENDS]
    bounds, start = [], 0
    while len(text) - start > size:
        end = start + size
        for mark, places in zip(marks, kinds):
            last = bisect_right(places, start + size - len(mark)) - 1
            if last >= 0 and places[last] > start + size // 2:
                end = places[last] + (0 if mark is PARAGRAPH else len(mark))
                break
        bounds.append((start, end))
        start = max(start + 1, end - overlap)
    return [*bounds, (start, len(text))]


def split_text(text: str | None, size: int, overlap: int) -> list[str]:
    """Overlapping chunks; None gives none, a short text itself. The overlap must be less than half the size."""
    if text is None:
        return []
    return [text] if len(text) <= size else [text[a:b] for a, b in chunk_bounds(text, size, overlap)]


def chunks(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    if overlap * 2 >= size:
        raise ValueError("the overlap must be less than half the size")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    return split(text)
