"""Several values packed in one field: one row for each value, with its position.

A finite-state tokenizer runs over each field once. Its states are: before a value,
inside a quoted value, inside a bare value, after a quoted value. It tracks the
quote that is open, escapes and the depth of list brackets, and ends a value at a
delimiter outside quotes. The tokenizer is the body of an Arrow-batched UDF;
splitting into rows, positions and everything around it is Spark's.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates values outside quotes, the comma apart.
DELIMITERS = ";|\n\r\t·•、；"
_BREAK = re.compile(r"<br\s*/?>", re.IGNORECASE)
_MARK = re.compile(r"(?:\(\d{1,3}\)|\d{1,3}[.)]|[-–—*•‣])\s+")
_CLOSERS = {'"': '"', "“": "”“", "„": "“”", "«": "»", "'": "'"}
_AFTER = re.compile(r"\s*(?=$|[,\];|·•、；]|<br\s*/?>|/(?!\S))|[^\S\n\r\t]*(?=[\n\r\t])", re.IGNORECASE)
_JSON_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])')
_STOP = {c: re.compile(rf"[\\\]{DELIMITERS}{',' if c else ''}]|<br\s*/?>|(?<!\S)/(?!\S)", re.IGNORECASE) for c in (True, False)}
_SPACE = re.compile(r"\s*")


def _quoted(s: str, i: int, in_list: bool) -> tuple[str, int] | None:
    """The value of the quote opened at i and the place behind it; None if nothing closes it before a delimiter."""
    closers, out, start, j = _CLOSERS[s[i]], [], i + 1, i + 1
    stop = re.compile(f"[\\\\{closers}]")
    while m := stop.search(s, j):
        j = m.start()
        if s[j] == "\\":
            if in_list and (e := _JSON_ESCAPE.match(s, j)):
                run = e.end()
                while s[j + 1] == "u" and (e := _JSON_ESCAPE.match(s, run)) and s[run + 1] == "u":
                    run = e.end()  # both halves of a surrogate pair are decoded together
                try:
                    out += [s[start:j], json.loads(f'"{s[j:run]}"')]
                except ValueError:
                    out += [s[start:run]]
                start = j = run
            elif j + 1 < len(s) and (s[j + 1] in closers or s[j + 1] in "\\,;|"):
                out += [s[start:j], s[j + 1]]
                start = j = j + 2
            else:
                j += 1
        elif s[j] == s[i] and s[j + 1 : j + 2] == s[j]:
            out += [s[start : j + 1]]
            start = j = j + 2
        elif m := _AFTER.match(s, j + 1):
            return "".join([*out, s[start:j]]), m.end()
        else:
            j += 1
    return None


def tokenize(text: str | None, comma: bool = True) -> list[str]:
    """The values of one field, in order.

    Values are trimmed and free of list marks (bullets, numbers), outer quotes,
    escapes and list brackets; empty pieces are left out; repeats stay. With
    `comma` false a comma ends a value only behind a closing quote, so that a bare
    statement keeps its commas. None and blank give []. A quote that never closes
    is an ordinary character. Time is linear in the length of the text.
    """
    if text is None:
        return []
    s = text.strip()
    depth, out, i, n, stop = 0, [], 0, len(s), _STOP[comma]
    listed = s[:1] == "[" and s[-1:] == "]"
    unclosed: set[str] = set()
    while i < n:
        i = _SPACE.match(s, i).end()
        if listed and s[i : i + 1] == "[":
            depth, i = depth + 1, i + 1
            continue
        if m := _MARK.match(s, i):
            i = m.end()
        quote = s[i : i + 1]
        if quote in _CLOSERS and quote not in unclosed:
            if found := _quoted(s, i, depth > 0):
                value, i = found
                out.append(value.strip())
                i = _behind(s, i, listed)
                continue
            unclosed.add(quote)
        piece: list[str] = []
        start = i
        while True:
            m = stop.search(s, i)
            if not m:
                piece.append(s[start:])
                i = n
                break
            j, what = m.start(), m.group()
            if what == "\\":
                nxt = s[j + 1 : j + 2]
                if nxt and (nxt in ",\\\"'/[]" or nxt in DELIMITERS):
                    piece += [s[start:j], nxt]
                    start = i = j + 2
                else:
                    i = j + 1
            elif what == "]" and not (listed and depth and _AFTER.match(s, j + 1)):
                i = j + 1
            else:
                piece.append(s[start:j])
                if what == "]":
                    depth -= 1
                i = m.end()
                break
        out.append("".join(piece).strip())
    return [v for v in out if v]


def _behind(s: str, i: int, listed: bool) -> int:
    """The place behind the delimiter (and closed brackets) that follow a quoted value."""
    while listed and s[i : i + 1] == "]":
        i = _SPACE.match(s, i + 1).end()
    if m := _BREAK.match(s, i):
        return m.end()
    return i + 1


def tokens(column: Column, comma: bool) -> Column:
    """ARRAY<STRING> of the values packed in a string column."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenize(t, comma))

    return split(column)


def unpack(rows: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """(key, field, pos, value): one row for each value of each packed field.

    `fields` names the packed columns and says of each whether a bare comma
    separates. Other columns are not read. Rows with a null or empty field give no
    row for it; an empty table gives an empty result.
    """
    packed = rows.select(
        F.col(key),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f), c).alias("vals")) for f, c in fields.items()])
        ).alias("packed"),
    )
    return packed.select(key, "packed.field", F.posexplode("packed.vals").alias("pos", "value"))
