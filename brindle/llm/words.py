"""Words of a text for comparing wordings: case, punctuation, white space and markup don't count."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: characters without a width, inline tags (nothing), other tags and escapes (a space), marks inside a word (nothing).
INVISIBLE = re.compile("[­​-‏⁠﻿]")
INLINE_TAG = re.compile(r"</?(?:a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?>")
OTHER_TAG = re.compile(r"</?[a-z!][^<>]*>")
ESCAPE = re.compile(r"\\[nrt]")
JOINED = re.compile(r"(?<=[^\W_])[-'’‐‑](?=[^\W_])")
PLAIN_WORD = re.compile(r"[a-z0-9]+")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def split_words(text: str | None) -> list[str]:
    """The lower-case words of a text, in order; none for null.

    Hyphens and apostrophes inside a word are dropped, so that `e-mail` is one word;
    entities are read as what they stand for, composed and decomposed letters are equal.
    """
    if not text:
        return []
    plain = text.lower()
    if "<" in plain:
        plain = OTHER_TAG.sub(" ", INLINE_TAG.sub("", plain))
    if "&" in plain:
        plain = html.unescape(plain).lower()
    if "\\" in plain:
        plain = ESCAPE.sub(" ", plain)
    if plain.isascii():
        return PLAIN_WORD.findall(JOINED.sub("", plain))
    return WORD.findall(JOINED.sub("", INVISIBLE.sub("", unicodedata.normalize("NFC", plain))))


def words(text: Column) -> Column:
    """ARRAY<STRING> of the words of a text; empty for null."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([split_words(t) for t in texts], dtype=object)

    return split(text)
