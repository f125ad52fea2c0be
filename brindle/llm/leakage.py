"""Held-out test items whose wording stands, fully or partly, in a training corpus.

A positional inverted index of the corpus is built for the terms of the test items.
It is partitioned by documents: each document's postings (term, position) are kept
together, so that lists are intersected where they lie and no term, however frequent,
is gathered in one place. The index gives the terms' document frequencies. Every run
of `run` words of an item is looked up by its rarest term; the postings of its next
rarest terms, moved by their offsets in the item, are intersected with them. What is
left is a place in a document where an item may begin; the words around it are aligned
with the item, and a stretch of at least `least` words of which at most one in `rate`
is altered (replaced, dropped or put in) makes a leak.

The search is complete: a stretch of L >= 20 words with at most L / 12 alterations
holds a run of 8 unaltered words (22 words in three runs is the worst case), so
`run` = 8 misses nothing at the default `least` and `rate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.words import split_words, words
from brindle.sources.scratch import Scratch

#: Items are searched in blocks of about this many words, whose terms and runs are sent to all tasks (below 100 MB).
BLOCK_WORDS = 500_000


def stretch(doc: list[str], item: list[str], least: int, rate: int) -> tuple[int, int, int] | None:
    """(start in the item, words, altered) of the longest stretch of the item in the words; None if there is none.

    A stretch begins and ends with a word that is not altered.
    From the start of each run of equal words the alignment is carried on with ever
    more alterations, keeping for each shift between the two the furthest place
    reached. An alignment is given up where its alterations outnumber the allowed
    ones by more than `least` words could make good: if it came to a stretch later,
    what follows the bad beginning would be one by itself. Of equally long stretches
    the one with fewer alterations, then the earlier one, is given.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    n, m, best = len(item), len(doc), None
    if sum([w in places for w in item]) < least - least // rate:  # too few words in common for any stretch
        return None
    for i0, w in enumerate(item):
        if n - i0 < least:
            break
        for j0 in places.get(w, ()):
            if i0 and j0 and item[i0 - 1] == doc[j0 - 1]:
                continue
            reach = {0: i0}
            for altered in range((n - i0) // rate + 1):
                for shift, before in reach.items():
                    i = before
                    j = j0 + (i - i0) + shift
                    while i < n and j < m and item[i] == doc[j]:
                        i, j = i + 1, j + 1
                    reach[shift] = i
                    size = i - i0
                    if i > before and size >= least and altered * rate <= size and (best is None or size > best[1]):
                        best = (i0, size, altered)
                nxt: dict[int, int] = {}
                for shift, i in reach.items():
                    if i - i0 < (altered + 1) * rate - least:
                        continue
                    for s, to in ((shift, i + 1), (shift - 1, i + 1), (shift + 1, i)):
                        if to <= n:
                            nxt[s] = max(nxt.get(s, 0), to)
                if not nxt:
                    break
                reach = nxt
    return best


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, words) of each item, without sentences that several different items share."""
    parts = (
        items.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(key).alias("item_id"))
        .agg(F.min(text).alias("t"))
        .select("item_id", "t", F.posexplode(F.split("t", r"(?<=[.?!])\s+")).alias("n", "sentence"))
        .select("item_id", "t", "n", words(F.col("sentence")).alias("w"))
    )
    shared = parts.groupBy("w").agg(F.countDistinct("t").alias("texts")).where("texts > 1").select("w")
    return (
        parts.join(shared, "w", "left_anti")
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("s"))
        .select("item_id", F.flatten(F.col("s.w")).alias("words"))
    )


class Runs:
    """The runs of a block of items as arrays, grouped by their rarest term; all bounded by the block's words."""

    def __init__(self, rows: pa.Table, terms: dict[str, int], further: int):
        first = np.array([terms[t] for t in rows.column("term").to_pylist()], dtype=np.int64)
        order = np.argsort(first, kind="stable")
        self.first = np.searchsorted(first[order], np.arange(len(terms) + 1))
        self.item = rows.column("item").to_numpy()[order]
        self.ipos = rows.column("ipos").to_numpy()[order]
        rest = rows.column("rest").to_pylist()
        self.rest = np.array([[(terms[r["term"]], r["ipos"]) for r in rest[i]] for i in order], dtype=np.int64).reshape(len(order), further, 2)

    def places(self, doc: np.ndarray, term: np.ndarray, pos: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, base) where all terms of a run stand at their places, the postings sorted by document and position; of near bases the first."""
        runs = self.first[term + 1] - self.first[term]
        posting = np.repeat(np.arange(len(term)), runs)
        run = np.arange(len(posting)) - np.repeat(np.cumsum(runs) - runs, runs) + self.first[term][posting]
        base = pos[posting] - self.ipos[run]
        width = int(pos.max(initial=0)) + 2
        keys = doc * width + pos
        for k in range(self.rest.shape[1]):
            at = base + self.rest[run, k, 1]
            wanted = doc[posting] * width + at
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            met = (at >= 0) & (at < width) & (keys[found] == wanted) & (term[found] == self.rest[run, k, 0])
            posting, run, base = posting[met], run[met], base[met]
        rows = np.stack([doc[posting], self.item[run], base // near, base], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)] if len(rows) else np.zeros(0, dtype=bool)
        return rows[new, 0], rows[new, 1], rows[new, 3]


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", key: str = "item_id",
    item_text: str = "text", least: int = 20, rate: int = 12, run: int = 8, further: int = 3, block: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, item_start, n_words, altered) of the longest stretch of each leaked item in each document.

    Null, empty and short texts on either side give no row, nor do rows without an
    id; repeated rows count once; columns other than those named are not read;
    empty tables give an empty result. Items of more than `block` words in all are
    searched in as many blocks as it takes.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    source = scratch.keep(item_words(items, key, item_text).where(F.size("words") >= least))
    corpus = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    blocks = max(1, -(-(source.agg(F.sum(F.size("words"))).first()[0] or 0) // block))
    parts = [source.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    found = [_leaks_of_block(corpus, part, scratch, least, rate, run, further) for part in parts]
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_words", (-F.col("altered")).alias("less"), (-F.col("item_start")).alias("early"))).alias("m"))
        .select("doc_id", "item_id", (-F.col("m.early")).alias("item_start"), F.col("m.n_words").alias("n_words"), (-F.col("m.less")).alias("altered"))
    )


def _leaks_of_block(corpus: DataFrame, source: DataFrame, scratch: Scratch, least: int, rate: int, run: int, further: int) -> DataFrame:
    context = corpus.sparkSession.sparkContext
    doc_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((corpus, "doc_id"), (source, "item_id")))
    of_items = source.orderBy("item_id").toArrow()  # bounded by the block's words
    ids, texts = of_items.column("item_id"), of_items.column("words").to_pylist()
    terms = {t: i for i, t in enumerate(sorted({w for ws in texts for w in ws}))}
    sent_terms = context.broadcast(terms)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent_terms.value.get
        for batch in batches:
            term, pos, n = [], [], []
            for t in batch.column("text").to_pylist():
                found = [place(w, -1) for w in split_words(t)]
                at = [i for i, x in enumerate(found) if x >= 0]
                term += [found[i] for i in at]
                pos += at
                n.append(len(at))
            ends = pa.array(np.cumsum([0, *n], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, pos)]], names=["doc_id", "term", "pos"])

    index = scratch.keep(corpus.mapInArrow(postings, f"doc_id {doc_type}, term array<int>, pos array<int>").where(F.size("term") >= least - least // rate))
    counted = index.select(F.explode(F.array_distinct("term")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # at most the block's terms
    df_of = np.zeros(len(terms) + 1, dtype=np.int64)
    df_of[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    known = corpus.sparkSession.createDataFrame(pa.table({"term": list(terms), "df": df_of[: len(terms)]}) if terms else pa.table({"term": pa.array([], pa.string()), "df": pa.array([], pa.int64())}))

    # The rarest terms of each run of an item; a run with a term that the corpus lacks stands nowhere.
    numbered = corpus.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "words": pa.array(texts, pa.list_(pa.string()))}))
    placed = numbered.select("item", F.posexplode("words").alias("ipos", "term")).join(F.broadcast(known), "term")
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, run - 1)
    rest = F.transform(F.slice("w", 2, further), lambda x: F.struct(x.term.alias("term"), x.ipos.alias("ipos")))
    runs = (
        placed.withColumn("w", F.array_sort(F.collect_list(F.struct("df", "term", "ipos")).over(ahead)))
        .where((F.size("w") == run) & (F.col("w")[0].df > 0))
        .select("item", F.col("w")[0].term.alias("term"), F.col("w")[0].ipos.alias("ipos"), rest.alias("rest"))
        .distinct()
    )
    sent_runs = context.broadcast(Runs(runs.toArrow(), terms, further))  # bounded by the block's words

    def intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("term")
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at, item, base = sent_runs.value.places(doc, lists.flatten().to_numpy().astype(np.int64), batch.column("pos").flatten().to_numpy().astype(np.int64), 16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(base, pa.int64())], names=["doc_id", "item", "base"])

    # Rows of one document delivered twice give the same places once.
    places = scratch.keep(index.mapInArrow(intersected, f"doc_id {doc_type}, item bigint, base bigint").groupBy("doc_id", "item", F.floor(F.col("base") / 16).alias("near")).agg(F.min("base").alias("base")))
    few = places.count() < 200_000
    around = corpus.join(F.broadcast(places) if few else places, "doc_id").select("doc_id", "text", "item", "base")
    sent_items = context.broadcast((ids.to_pylist(), texts))
    margin = 16 + 2 * run

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, item_texts = sent_items.value
        kind = ids.type
        for batch in batches:
            rows, last, of_doc = [], None, []
            for i, (t, item, base) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("text", "item", "base")])):
                if t is not last and t != last:
                    last, of_doc = t, split_words(t)
                start, words_of_item = max(base - margin, 0), item_texts[item]
                if s := stretch(of_doc[start : base + len(words_of_item) + margin + 16], words_of_item, least, rate):
                    rows.append((i, item_ids[item], *s))
            at, found, *numbers = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(found, kind), *[pa.array(n, pa.int32()) for n in numbers]], names=["doc_id", "item_id", "item_start", "n_words", "altered"]
            )

    return around.mapInArrow(aligned, f"doc_id {doc_type}, item_id {item_type}, item_start int, n_words int, altered int")
