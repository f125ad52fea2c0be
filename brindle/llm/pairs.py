"""Broken pairs of prompt and response, each with the kind of its defect.

Refusals are told by recurrence, without any list of phrases: the openings of all
responses, freed from their wrapping, are clustered by their verified shingles. An
answer says something on its prompt, so its opening comes with other values and
statements, or under prompts of one task only. A cluster whose responses are nearly
all bare (one running text and nothing else, in any wrapping), and that recurs under
unrelated prompts and in different tasks, is a template of refusal with all its
variants. Empty shells, copies of the prompt, answers in another language and cut
answers are told pair by pair.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import minhash, truncation
from brindle.sources.scratch import Scratch

#: Answers that hold the place of an answer.
PLACEHOLDERS = {"", "n/a", "na", "none", "null", "nil", "undefined", "nan", "tbd", "todo", "-", "--", "—", "–", ".", "..", "...", "…", "?", "\"\"", "''", "{}", "[]", "empty", "(empty)", "[empty]", "k. a.", "k.a."}

#: Frequent small words that tell four languages apart.
SMALL_WORDS = {
    "en": "the and is are of to in for with that by you it on was were be been has have from this which at as or not they when your their its who than each before after more into because since can will about first all how",
    "de": "der die das und ist sind mit für von zu den dem des eine einen einer ein nicht wird werden im wir sie es auf aus bei nach über als auch wie durch sich am an zum zur oder bis denn ohne warum unter sobald alle diese dieser ihre seit zwischen",
    "fr": "le la les des et est sont pour avec que une un sur dans du au aux par ce cette qui ne pas plus de en il elle nous vous leur ses son sa d l qu à été ou comme sans car dès dont à chez mais entre avant",
    "es": "el la los las y es son para con que una un sobre del se por en de al lo su sus más no como sin desde cuando hay pero o esta este cada ya porque antes después entre al cómo qué depende",
}
_LANGUAGE_OF = {w: [c for c, ws in SMALL_WORDS.items() if w in ws.split()] for ws in SMALL_WORDS.values() for w in ws.split()}
_WEIGHTS = {w: tuple(1 / len(of) if c in of else 0.0 for c in SMALL_WORDS) for w, of in _LANGUAGE_OF.items()}
#: Names of the languages, as they are asked for.
ASKED = {
    "en": r"english|englisch\w*|anglais|inglés",
    "de": r"german|deutsch\w*|allemand|alemán",
    "fr": r"french|französisch\w*|français|francés",
    "es": r"spanish|spanisch\w*|espagnol|español",
}
_ASKS = re.compile(r"\b(?:in|auf|en|into|ins|al|au)\s+(?:" + "|".join(f"(?P<{c}>{names})" for c, names in ASKED.items()) + r")\b")
_FENCE = re.compile(r"\A\s*```[\w-]*\s*|\s*```\s*\Z")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|\Z)', re.DOTALL)
_FIRST = re.compile(r"(?<=[.!?])\s")
_LIST_MARK = re.compile(r"^\s*(?:[-*•]\s+|>+\s*|#+\s+|\d+[.)]\s+)")
_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"\w+://\S+")
_KEY = re.compile(r'"\s*:')


def _decoded(s: str) -> str:
    if "\\" not in s:
        return s
    try:
        return json.loads(f'"{s}"', strict=False)
    except ValueError:
        return re.sub(r"\\.?", " ", s)


def values_in(response: str | None) -> int:
    """How many values a response holds, fences left out: the lines of prose, or the values of JSON that aren't blank or placeholders.

    0 is an empty shell; `false`, `true` and numbers are values. JSON that can't be
    read has as many values as keys, one at least, and JSON behind prose one more.
    """
    t = (response or "").strip()
    while (bare := _FENCE.sub("", t).strip()) != t:
        t = bare
    if t.casefold() in PLACEHOLDERS:
        return 0
    if t[:1] not in "[{\"":
        return 2 if truncation._JSON_START.search(t) else sum(1 for line in t.split("\n") if line.strip())
    try:
        left = [json.loads(t)]
    except (ValueError, RecursionError):
        return max(len(_KEY.findall(t)), 1)
    n = 0
    while left:
        v = left.pop()
        if isinstance(v, dict):
            left += v.values()
        elif isinstance(v, list):
            left += v
        else:
            n += v is not None and not (isinstance(v, str) and v.strip().casefold() in PLACEHOLDERS)
    return n


def is_empty(response: str | None) -> bool:
    """Null, blank, a placeholder, or JSON all of whose values are blank."""
    return values_in(response) == 0


def statements(response: str) -> list[str]:
    """The running texts of a response: the sentence-like strings of JSON, or the text's own lines."""
    t = _FENCE.sub("", response)
    start = truncation._JSON_START.search(t)
    if start:
        found = [t[: start.start()]] + [_decoded(m) for m in _STRING.findall(t[start.start() :]) if " " in m]
    else:
        found = t.split("\n")
    found = [_LIST_MARK.sub("", _ADDRESS.sub(" ", x) if "://" in x else x).strip() for x in found]
    return [x for x in found if x and not (x.startswith("**") and x.endswith("**"))]


def opening_sentence(response: str, told: list[str] | None = None) -> str:
    """The first sentence of the first running text of three words or more; '' if there is none. `told`: the response's statements, if known."""
    for s in statements(response) if told is None else told:
        first = _FIRST.split(s, maxsplit=1)[0]
        if first.count(" ") >= 2 and not s.endswith(":"):
            return first
    return ""


def even(sentence: str) -> str:
    """A sentence in lower case, with numbers and punctuation evened out."""
    words = _WORD.findall(re.sub(r"['’]", "", sentence.lower()))
    return " ".join("0" if w.isdigit() else w for w in words)


def language(texts: list[str]) -> str:
    """The language of running text by its small words; '' if it isn't plain."""
    small = [_WEIGHTS[w] for w in _WORD.findall(" ".join(texts).lower()) if w in _WEIGHTS]
    if not small:
        return ""
    (n, best), (second, _) = sorted(zip(map(sum, zip(*small)), SMALL_WORDS), reverse=True)[:2]
    return best if n >= 2 and n >= 1.25 * second else ""


def asked_language(prompt: str) -> str:
    """The language that a prompt asks for, or else its own."""
    asked = {m.lastgroup for m in _ASKS.finditer(prompt.lower())}
    return asked.pop() if len(asked) == 1 else language([_ADDRESS.sub(" ", prompt)])


def is_wrong_language(prompt: str | None, response: str | None, told: list[str] | None = None) -> bool:
    """Whether the response's descriptive sentences (five words or more) are in another language than asked for; `told`: its statements, if known."""
    if not prompt or not response:
        return False
    told = [s for s in (statements(response) if told is None else told) if s.count(" ") >= 4 and not s.endswith(":")]
    is_in = language(told)
    return bool(is_in) and (wanted := asked_language(prompt)) not in ("", is_in)


def copied_share(prompt: str | None, response: str | None, run: int = 13, least: float = 0.0) -> float:
    """The share of the response's words that lie in runs of `run` or more words of the prompt, in order, addresses left out.

    `run` is longer than a sentence that prompt and response may share by chance; a
    response of fewer words counts as one run. Where fewer of the response's words
    than the share `least` occur in the prompt at all, the result is 0.
    """
    if not prompt or not response:
        return 0.0
    a, b = (_WORD.findall(_ADDRESS.sub(" ", t).lower()) for t in (prompt, _plain(response)))
    run = min(run, len(b))
    if run < 4 or len(a) < run:
        return 0.0
    words = set(a)
    if sum([w in words for w in b]) < least * len(b):
        return 0.0
    known = {tuple(a[i : i + run]) for i in range(len(a) - run + 1)}
    covered, until = 0, 0
    for i in range(len(b) - run + 1):
        if tuple(b[i : i + run]) in known:
            covered += i + run - max(i, until)
            until = i + run
    return covered / len(b)


def _plain(response: str) -> str:
    """Escapes of JSON strings read as what they stand for."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), response).replace("\\n", " ") if "\\" in response else response


def traits_of(prompt: str | None, response: str | None) -> tuple:
    n = values_in(response)
    if n == 0:
        return True, "", False, False, False
    told = statements(response)
    return False, even(opening_sentence(response, told)), n == 1, copied_share(prompt, response, least=0.5) >= 0.5, is_wrong_language(prompt, response, told)


def refusal_openings(traits: DataFrame, prompts: DataFrame, keys: list[str], recurring: int = 3, tasks: int = 2, bare: float = 0.9) -> DataFrame:
    """(opening) of the clusters whose responses are bare in the share `bare`, under `recurring` or more unrelated prompts of `tasks` or more tasks.

    `traits` has keys, task, opening and bare, `prompts` the keys and the prompt.
    Prompts are unrelated that fall in different clusters of the prompts' texts,
    addresses left out and numbers evened out: retried calls, variants of one opening
    and prompts of one template with other addresses count once. Only prompts on
    which a cluster depends are read.
    """
    scratch = Scratch(traits.sparkSession, "refusals")
    opened = traits.where("opening <> ''")
    by_task = scratch.keep(opened.groupBy("opening", "task").agg(F.count("*").alias("n"), F.count_if("bare").alias("bare")))
    placed = scratch.keep(by_task.join(minhash.clusters(by_task.select("opening").distinct(), "opening"), "opening"))
    of_cluster = placed.groupBy("cluster", "task").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare")).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"), F.count("*").alias("tasks"))
    unsure = of_cluster.where((F.col("bare") >= bare * F.col("n")) & (F.col("n") >= recurring) & (F.col("tasks") >= tasks)).select("cluster")
    openings = scratch.keep(placed.join(unsure, "cluster", "left_semi").select("opening", "cluster").distinct())
    under = scratch.keep(opened.select(*keys, "opening").join(openings, "opening").select(*keys, "cluster"))

    @F.pandas_udf("string")
    def evened(texts: pd.Series) -> pd.Series:
        return pd.Series([even(_ADDRESS.sub(" ", t or "")) for t in texts], dtype=object)

    read = prompts.join(F.broadcast(under) if under.count() < 200_000 else under, keys)
    asked = scratch.keep(read.select("cluster", evened("prompt").alias("asked")).distinct())
    alike = minhash.clusters(asked, "asked").withColumnRenamed("cluster", "asked_alike")
    recurs = asked.join(alike, "asked").groupBy("cluster").agg(F.count_distinct("asked_alike").alias("prompts"))
    return openings.join(recurs.where(F.col("prompts") >= recurring), "cluster", "left_semi").select("opening")


def defects(calls: DataFrame, prompt: str = "prompt_preview", response: str = "response_preview", keys: tuple[str, ...] = ("run_id", "id"), source: str = "source", task: str = "task", recurring: int = 3) -> DataFrame:
    """(keys, defect) of every broken pair, once for each kind: empty, truncated, refusal, copy, wrong_language.

    Rows delivered twice count once. A null prompt can only have an empty, truncated
    or declining response; null tasks are one task. A refusal or copy has no wrong language, an empty
    response no other defect. An empty table gives an empty result.
    """
    scratch = Scratch(calls.sparkSession, "pairs")
    sizes = [f"m{k}" for k in range(len(truncation.MEASURES))]
    names = ["empty", "opening", "bare", "copy", "wrong_language", "verdict", "last", *sizes]

    @F.pandas_udf("empty boolean, opening string, bare boolean, copy boolean, wrong_language boolean, verdict string, last string, " + ", ".join(f"{m} int" for m in sizes))
    def traits(prompts: pd.Series, responses: pd.Series, hosts: pd.Series) -> pd.DataFrame:
        rows = [(*traits_of(p, r), *truncation.ending(r, False, h), *(truncation.lengths(r) if r is not None else [None] * len(sizes))) for p, r, h in zip(prompts, responses, hosts)]
        return pd.DataFrame(rows, columns=names).astype({m: "Int32" for m in sizes})

    each = scratch.keep(
        calls.select(*keys, F.col(task).alias("task"), F.col(source).alias("source"), F.xxhash64(response).alias("print"), traits(F.col(prompt), F.col(response), F.col(source)).alias("t"))
        .select(*keys, "task", "source", "print", "t.*")
        .dropDuplicates([*keys])
    )
    declining = refusal_openings(each, calls.select(*keys, F.col(prompt).alias("prompt")), [*keys], recurring).withColumn("refusal", F.lit(True))
    # Refusals are few openings: the size is checked before they are sent to all.
    declining = scratch.keep(declining)
    few = declining.count() < 200_000
    judged = each.join(F.broadcast(declining) if few else declining, "opening", "left").withColumn("refusal", F.coalesce("refusal", F.lit(False)) & ~F.col("empty") & ~F.col("copy"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("empty"), "empty"),
            F.when(F.col("refusal"), "refusal"),
            F.when(F.col("copy"), "copy"),
            F.when(F.col("wrong_language") & ~F.col("copy") & ~F.col("refusal"), "wrong_language"),
        )
    )
    told = judged.select(*keys, F.explode(kinds).alias("defect"))
    responses = each.where("m0 is not null").select(*keys, "source", F.lit(response).alias("field"), "verdict", F.col("last").alias("opening"), F.array(*sizes).alias("sizes"), "print")
    cut = truncation.cut_of(responses, each, [], keys).where("cut").select(*keys, F.lit("truncated").alias("defect"))
    return told.unionByName(cut)
