"""Texts cut off by field limits or in transfer.

Two kinds of evidence are joined. Storage limits: the length of each text is
recomputed under several measures (characters, UTF-8 bytes, UTF-16 units, HTML
entities, JSON escapes with and without characters beyond ASCII, CRLF line ends), and a length at which several texts of a
source end while none is longer, or clearly more end unfinished than at the lengths
around it, is a limit of that source and field, of which there may be several. Endings: a
text that ends within a word, a sentence or a JSON value, or with a sign of cutting,
is cut; one whose ending alone decides nothing (a heading, an address, a line of a
page without a full stop) is cut if it ends exactly at a limit, or if its last line
opens as sentences of the corpus do that always end with a full stop.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.scratch import Scratch

#: Signs put in the place of what was cut, and answers that are whole though they end oddly.
SIGN = re.compile(r"(?:…|\.\.\.|�+|[\[(<](?:…|\.\.\.|truncated|cut|snip|more|continued|gekürzt|tronqué|truncado|abgeschnitten)[^\[\]()<>]{0,30}[\])>])\s*$", re.IGNORECASE)
AND_SO_ON = re.compile(r"\b(?:and so (?:on|forth)|etc\.?|et cetera|und so weiter|usw\.?|et ainsi de suite|y así sucesivamente)\s*(?:…|\.\.\.)\s*$", re.IGNORECASE)
_ENDED = re.compile(r"[.?!:;。！？][\"'”’»«“)\]*_`]*$")
_CLOSED = re.compile(r"(?:\*\*|__|[`”»\"])$")
_URL = re.compile(r"https?://\S*$")
_FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\n?")
_JSON_START = re.compile(r"\{(?=\s*[\"}])|\A\s*\[(?=\s*[\]{\"\[\d])")
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|"', re.DOTALL)
_NEW_SENTENCE = re.compile(r"[.?!][\"'”’»)]*\s+(?=\S)")
_INNER_END = re.compile(r"\w\w[.?!][\"'”’»)]*\s+\S")

CUT, WHOLE, OPEN = "cut", "whole", "open"


def _json_end(text: str, start: int) -> int | None:
    """The place behind the JSON value that starts there; None if it isn't closed."""
    depth = 0
    for m in _JSON_TOKEN.finditer(text, start):
        c = m.group()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == '"':
            return None
    return None


def ending(text: str | None, page: bool = False, host: str | None = None) -> tuple[str, str]:
    """(verdict, last line) by the text's end alone: `cut`, `whole` or `open` (undecided).

    `page` says that the text is a piece of a page, whose lines needn't end with a
    full stop; `host` is the host of addresses in the text, a part of which at the
    end is a cut address. Null, blank and one-word texts are whole.
    """
    t = (text or "").rstrip()
    if len(t.split(None, 1)) < 2 and not (t and t[0] in "{[`") and not _URL.search(t):
        return (CUT, "") if len(t) > 1 and SIGN.search(t) and t.strip(".…") else (WHOLE, "")
    if AND_SO_ON.search(t):
        return WHOLE, ""
    if SIGN.search(t):
        return CUT, ""
    body, fence = t, _FENCE.match(t)
    if fence:
        body = t[fence.end() :]
        if body.endswith("```"):
            body = body[:-3].rstrip()
        if not body:
            return WHOLE, ""
    if not page and (m := _JSON_START.search(body)):
        end = _json_end(body, m.start())
        if end is None:
            return CUT, ""
        body = body[end:].strip(" \n`")
        if not body:
            return WHOLE, ""
    if body.endswith("```"):
        return WHOLE, ""
    line = body[body.rfind("\n") + 1 :]
    bare = line.strip()
    if m := _URL.search(bare):
        at = m.group().split("://", 1)[1]
        name = at.split("/", 1)[0]
        partial = bool(host) and name != host and (host.startswith(name) and "/" not in at)
        if "(" in bare[: m.start()][-1:] and not bare.endswith(")"):
            partial = True
        return (CUT, "") if partial or not at else (OPEN if not bare.endswith(")") else WHOLE, "")
    if _ENDED.search(bare) or _CLOSED.search(bare):
        return WHOLE, ""
    if bare.startswith("|"):
        return (WHOLE if bare.endswith("|") and len(bare) > 1 else CUT), ""
    if bare.count("[") > bare.count("]"):
        return CUT, ""
    if line.startswith("    ") or bare.startswith("#"):
        return OPEN, ""
    if bare.endswith(")"):
        return WHOLE, ""
    if not page:
        return CUT, ""
    if _INNER_END.search(bare) and not bare.startswith("©"):
        return CUT, ""
    return OPEN, opening_of(bare)


def opening_of(line: str) -> str:
    """The first two words of a line's last sentence, without list marks."""
    last = _NEW_SENTENCE.split(re.sub(r"^(?:[-*•–>]|\d+[.)])\s+", "", line))[-1]
    words = last.split()
    return " ".join(words[:2]) if len(words) > 2 else ""


#: The measures of a text's length, in the order of `lengths`.
MEASURES = ["characters", "utf8_bytes", "utf16_units", "html_escaped", "json_escaped", "json_ascii", "crlf_lines"]
_CONTROL = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")


def lengths(text: str) -> list[int]:
    """The length of a text as different stores would count it (see MEASURES).

    HTML escapes `& < > " '`; JSON escapes quotes, backslashes and control characters,
    and in its ASCII form every other character beyond ASCII (two escapes for one
    beyond the basic plane).
    """
    n, count = len(text), text.count
    newlines = count("\n")
    html = n + 4 * count("&") + 3 * (count("<") + count(">")) + 5 * count('"') + 4 * count("'")
    json = n + count('"') + count("\\") + newlines + count("\r") + count("\t") + count("\b") + count("\f") + 5 * len(_CONTROL.findall(text))
    if text.isascii():
        return [n, n, n, html, json, json, n + newlines]
    utf8 = len(text.encode("utf-8", "surrogatepass"))
    utf16 = len(text.encode("utf-16-le", "surrogatepass")) // 2
    beyond = n - len(text.encode("ascii", "ignore"))
    return [n, utf8, utf16, html, json, json + 5 * beyond + 6 * (utf16 - n), n + newlines]


def limits(sized: DataFrame, reach: int = 64) -> DataFrame:
    """(source, field, m, size, texts) of all limits under measure m, with the number of different texts that end there: a source may change its limits, so there may be several.

    A limit is the greatest length of a source's field, where two different texts end
    there, and every length at which clearly more different texts end unfinished than
    at the lengths up to `reach` away (by Chernoff's bound on that rate, with one text
    added to the neighbours), one at least in a cut ending, two where the odds are weaker.
    """
    cells = ["source", "field", "m"]
    texts = sized.select("source", "field", "print", "sizes", "verdict").distinct()
    sizes = texts.select("source", "field", "verdict", F.posexplode("sizes").alias("m", "size"))
    counted = sizes.groupBy(*cells, "size").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != WHOLE).alias("unfinished"), F.count_if(F.col("verdict") == CUT).alias("cut"))
    # The windows run over lengths, not texts: a group has as many rows as different lengths.
    around = Window.partitionBy(*cells).orderBy("size").rangeBetween(-reach, reach)
    rated = counted.withColumn("top", F.max("size").over(Window.partitionBy(*cells))).withColumn("rate", (F.sum("unfinished").over(around) - F.col("unfinished") + 1) / F.lit(2.0 * reach))
    n = F.col("unfinished")
    odds = F.when(n > F.col("rate"), n * (F.log(n / F.col("rate")) - 1) + F.col("rate")).otherwise(0.0)
    found = (F.col("size") == F.col("top")) & (F.col("n") >= 2) | (odds >= 12) & (F.col("cut") >= 1) | (odds >= 9) & (F.col("cut") >= 2)
    return rated.where(found).select(*cells, "size", F.col("n").alias("texts"))


def openings(pages: Column, whole: bool) -> Column:
    """The openings of the sentences of a page text that end with a full stop, or of its lines that don't."""
    start = r"(?:^|(?<=[.?!] ))(?:[-*•–>] |\d+[.)] )?"
    rest = r"(?:[^.?!\n]|[.?!](?![ \n]|$))*"
    tail = r"[.?!]" if whole else r"[^.?!\n](?=\n)"
    return F.regexp_extract_all(pages, F.lit(rf"(?m){start}([^\s#|\[]\S* \S+)(?: {rest})?{tail}"), F.lit(1))


def judged_texts(events: DataFrame, fields: list[str], page_fields: list[str], keys: tuple[str, ...] = ("run_id", "id"), source: str = "source") -> DataFrame:
    """(keys, source, field, verdict, opening, sizes, print) of every non-null text of the fields: its ending, its length under each measure, its hash."""
    base = events.select(*keys, F.col(source).alias("source"), *fields)
    measured = [f"m{k} int" for k in range(len(MEASURES))]

    def judged(field: str) -> Column:
        page = field in page_fields

        @F.pandas_udf(", ".join(["verdict string", "opening string", *measured]))
        def verdict(texts: pd.Series, hosts: pd.Series) -> pd.DataFrame:
            rows = [(*ending(t, page, h), *(lengths(t) if t is not None else [None] * len(MEASURES))) for t, h in zip(texts, hosts)]
            columns = ["verdict", "opening", *[f"m{k}" for k in range(len(MEASURES))]]
            return pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in columns[2:]})

        return verdict(F.col(field), F.col("source"))

    texts = F.array(*[F.struct(F.lit(f).alias("field"), judged(f).alias("j"), F.xxhash64(f).alias("print"), F.col(f).isNotNull().alias("given")) for f in fields])
    sizes = F.array(*[F.col(f"v.j.m{k}") for k in range(len(MEASURES))]).alias("sizes")
    return base.select(*keys, "source", F.explode(texts).alias("v")).where("v.given").select(*keys, "source", "v.field", "v.j.verdict", "v.j.opening", sizes, "v.print")


def cut_texts(events: DataFrame, fields: list[str], page_fields: list[str], keys: tuple[str, ...] = ("run_id", "id"), source: str = "source") -> DataFrame:
    """(keys, source, field, cut) of every non-null text of the fields, once for each event.

    Rows delivered twice count once. Texts without letters, of one word or blank
    are whole. A null source is a source of its own without limits. An empty table
    gives an empty result.
    """
    base = events.select(*keys, F.col(source).alias("source"), *fields)
    verdicts = Scratch(events.sparkSession, "cut").keep(judged_texts(events, fields, page_fields, keys, source))
    return cut_of(verdicts, base, page_fields, keys)


def cut_of(verdicts: DataFrame, base: DataFrame, page_fields: list[str], keys: tuple[str, ...]) -> DataFrame:
    """`cut_texts` of texts that are judged already; `base` has the page fields themselves."""
    bound = limits(verdicts)
    undecided = verdicts.where(F.col("verdict") == OPEN)
    at = (
        undecided.select(*keys, "source", "field", F.posexplode("sizes").alias("m", "size"))
        .join(bound, ["source", "field", "m", "size"], "left_semi")
        .select(*keys, "field")
    )
    if page_fields:
        at = at.unionByName(_broken_sentences(undecided, base, keys, [F.col(f) for f in page_fields]))
    more = at.distinct().withColumn("more", F.lit(True))
    return (
        verdicts.join(more, [*keys, "field"], "left")
        .groupBy(*keys, "field")
        .agg(F.min("source").alias("source"), F.max((F.col("verdict") == CUT) | F.coalesce("more", F.lit(False))).alias("cut"))
    )


def _broken_sentences(undecided: DataFrame, base: DataFrame, keys: tuple[str, ...], pages: list[Column]) -> DataFrame:
    """(keys, field) of the undecided texts whose last line opens as whole sentences of the page texts do, and bare lines don't."""

    def counted(whole: bool, name: str) -> DataFrame:
        found = F.concat(*[F.coalesce(openings(c, whole), F.array()) for c in pages])
        return base.select(F.explode(found).alias("opening")).groupBy("opening").agg(F.count("*").alias(name))

    return (
        undecided.where("opening <> ''")
        .select(*keys, "field", "opening")
        .join(counted(True, "ended"), "opening")
        .join(counted(False, "unended"), "opening", "left")
        .where("ended >= 5 and ended >= 20 * coalesce(unended, 0)")
        .select(*keys, "field")
    )
