"""Subject areas of documents by latent semantic analysis around labelled seeds.

Terms are words hashed to a fixed number of buckets, so that every table kept on the
driver or sent to the tasks is bounded by parameters, at any corpus size. A term's
weight is its inverse document frequency times how far its subjects' distribution is
from the overall one: general words, names and practical matters weigh nothing. A
sentence is a vector of weights of length one at most, a document the sum of its
sentences, so that no sentence outweighs the others. The documents' truncated
singular value decomposition is found by subspace iteration: each pass multiplies
the basis by all documents in the tasks and adds up the partial products in Spark; a
round goes on from the basis of the round before. The tasks of a pass are as many as
the cluster's cores at most, however many files there are, so that what is added up
grows with the cluster and not with the corpus.

Seed centroids, for each subject and language, come from labelled documents and the
subjects' descriptions. All documents are then assigned by cosine similarity; the
plain ones become the seeds of the next round, which weighs the terms anew over the
whole corpus. A document treats a subject if its cosine to one of the subject's
centroids is high enough and at least two of its sentences are on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm.pairs import SMALL_WORDS
from brindle.sources.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """buckets: terms; rank: singular vectors; passes: subspace iterations of the first round, later ones go on with one each; weak: length below which a sentence isn't stretched to one."""

    buckets: int = 1 << 16
    rank: int = 48
    rounds: int = 3
    passes: int = 3
    smoothing: float = 3.0
    weak: float = 0.5
    least_documents: int = 3
    similarity: float = 0.3
    plain: float = 0.8
    seed: int = 7


_SENTENCE = re.compile(r"[.?!]\s+")
_PLAIN_WORD = re.compile(r"[a-z]{2,}")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
#: The code points among which combining marks lie, that the faster pattern would break words at.
_MARKS = ((0x300, 0x36F), (0x483, 0x1FFF), (0x20D0, 0x20FF), (0xA66F, 0xABFF))
_MARKED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _MARKS) + "]")
_WORD = regex.compile(r"[\p{L}\p{M}]{2,}")


class Terms(dict):
    """The term of each word, kept for the words met so far."""

    def __init__(self, buckets: int, kept: int = 500_000):
        super().__init__()
        self.buckets, self.kept = buckets, kept

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        found = self[word] = xxh64_intdigest(word) % self.buckets
        return found


def hashed_sentences(text: str | None, terms: Terms) -> list[list[int]]:
    """The terms of each sentence of a text that has any, in order."""
    low = (text or "").lower().replace("\n", ".\n")
    find = _PLAIN_WORD.findall if low.isascii() else _WORD.findall if _MARKED.search(low) else _LETTERS.findall
    return [list(map(terms.__getitem__, words)) for sentence in _SENTENCE.split(low) if (words := find(sentence))]


def _language_votes(buckets: int) -> np.ndarray:
    """buckets x languages: what each term's small words say of the language."""
    votes = np.zeros((buckets, len(SMALL_WORDS)), dtype=np.float32)
    terms = Terms(buckets)
    for i, ws in enumerate(SMALL_WORDS.values()):
        for w in ws.split():
            votes[terms[w], i] += 1
    return votes / np.maximum(votes.sum(1, keepdims=True), 1)


def prepared_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """The other columns of `rows`, and the language (a number) and the hashed sentences of each text that has any."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others] + ["language int, sentences array<array<int>>"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, terms = _language_votes(buckets), Terms(buckets)
        for batch in batches:
            found = [hashed_sentences(t, terms) for t in batch.column("text").to_pylist()]
            kept = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            found = [f for f in found if f]
            lengths = [len(s) for f in found for s in f]
            flat = np.fromiter((x for f in found for s in f for x in s), dtype=np.int32, count=sum(lengths))
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths], dtype=np.int32)), pa.array(flat))
            sentences = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), inner)
            language = np.zeros((len(found), votes.shape[1] + 1), dtype=np.float64)
            in_doc = np.repeat(np.arange(len(found)), [sum(map(len, f)) for f in found])
            for j in range(votes.shape[1]):
                language[:, j] = np.bincount(in_doc, weights=votes[flat, j], minlength=len(found))
            language[:, -1] = (language.max(1, initial=0) <= 0) * 1.0
            told = language.argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(kept) for c in others], pa.array(told), sentences], names=[*others, "language", "sentences"])

    return rows.mapInArrow(hashed, schema)


def _blocks(rows: np.ndarray, columns: np.ndarray, value: np.ndarray, n: int, m: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, columns used, dense block) of a sparse n x m matrix whose entries come by rows; nothing where it is too thinly filled for that."""
    used = np.flatnonzero(np.bincount(columns, minlength=m))
    if len(rows) * 60 <= n * len(used):
        return
    place = np.zeros(m, dtype=np.int64)
    place[used] = np.arange(len(used))
    at = place[columns]
    step = max(1, 1_000_000 // len(used))
    for a in range(0, n, step):
        b = min(a + step, n)
        lo, hi = np.searchsorted(rows, [a, b])
        filled = np.bincount((rows[lo:hi] - a) * len(used) + at[lo:hi], weights=value[lo:hi], minlength=(b - a) * len(used))
        yield slice(a, b), used, filled.astype(np.float32).reshape(b - a, len(used))


def _times(rows: np.ndarray, columns: np.ndarray, value: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix of n rows, given by its entries, with a dense one."""
    out = np.zeros((n, right.shape[1]), dtype=np.float32)
    if not len(rows):
        return out
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, columns, value = rows[order], columns[order], value[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    # In pieces that stay in the processor's cache.
    cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(rows), 16_384)), len(first)])
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = first[a], first[b] if b < len(first) else len(rows)
        taken = np.take(right, columns[lo:hi], axis=0)
        taken *= value[lo:hi, None]
        out[rows[first[a:b]]] = np.add.reduceat(taken, first[a:b] - lo, axis=0)
    return out


class _Model:
    """What the tasks need: weights, basis, centroids; all bounded by the settings."""

    def __init__(self, settings: Settings, weights: np.ndarray):
        self.s = settings
        self.active = np.flatnonzero(weights > 5e-4)
        self.slot = np.full(settings.buckets, -1, dtype=np.int32)
        self.slot[self.active] = np.arange(len(self.active), dtype=np.int32)
        self.weights = weights[self.active].astype(np.float32)
        self.basis = np.zeros((len(self.active), settings.rank), dtype=np.float32)
        self.centroids = np.zeros((0, settings.rank), dtype=np.float32)
        self.subject_of = np.zeros(0, dtype=np.int32)

    def parts(self, sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(sentence, slot, value) of each active term, the document of each sentence, number of documents."""
        if isinstance(sentences, pa.ChunkedArray):
            sentences = sentences.combine_chunks()
        n, outer = len(sentences), sentences.offsets.to_numpy()
        inner = sentences.flatten()
        in_doc = np.repeat(np.arange(n), np.diff(outer))
        slot = self.slot[inner.flatten().to_numpy(zero_copy_only=False)]
        sentence = np.repeat(np.arange(len(in_doc)), np.diff(inner.offsets.to_numpy()))
        keep = slot >= 0
        sentence, slot = sentence[keep], slot[keep]
        value = self.weights[slot]
        norm = np.sqrt(np.bincount(sentence, weights=value * value, minlength=len(in_doc)))
        value = value / np.maximum(norm, self.s.weak)[sentence].astype(np.float32)
        return sentence, slot, value, in_doc, n

    def embed(self, rows: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out, dense = np.zeros((n, self.s.rank), dtype=np.float32), False
        for part, used, block in _blocks(rows, slot, value, n, len(self.active)):
            out[part], dense = block @ self.basis[used], True
        return out if dense else _times(rows, slot, value, n, self.basis)

    def iterated(self, rows: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The basis multiplied by the documents' matrix, each document at length one, and by its transpose."""
        size = np.maximum(np.bincount(rows, weights=value * value, minlength=n), 1e-9)[:, None].astype(np.float32)
        out, dense = np.zeros((len(self.active), self.s.rank), dtype=np.float32), False
        for part, used, block in _blocks(rows, slot, value, n, len(self.active)):
            out[used] += block.T @ (block @ self.basis[used] / size[part])
            dense = True
        return out if dense else _times(slot, rows, value, len(self.active), _times(rows, slot, value, n, self.basis) / size)

    def subjects(self, vectors: np.ndarray, subjects: int) -> np.ndarray:
        """rows x subjects: the best cosine to a centroid of each subject."""
        out = np.full((len(vectors), subjects), -1, dtype=np.float32)
        if len(self.centroids):
            cosines = (vectors @ self.centroids.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
            first = np.flatnonzero(np.r_[True, self.subject_of[1:] != self.subject_of[:-1]])
            out[:, self.subject_of[first]] = np.maximum(out[:, self.subject_of[first]], np.maximum.reduceat(cosines, first, axis=1))
        return out


def _weights(documents: np.ndarray, total: int, by_subject: np.ndarray, s: Settings) -> np.ndarray:
    prior = (by_subject.sum(0) + 1) / (by_subject.sum() + by_subject.shape[1])
    share = (by_subject + s.smoothing * prior) / (by_subject.sum(1, keepdims=True) + s.smoothing)
    gain = np.clip((share * np.log(share / prior)).sum(1) / np.log(max(2, len(prior))), 0, None)
    idf = np.log(max(total, 1) / np.maximum(documents, 1))
    weights = np.where(documents >= min(s.least_documents, total), gain**1.5 * idf, 0.0)
    # In units of the weight that carries the most of the seeds' mass, so that no threshold depends on the corpus' size.
    mass = weights * by_subject.sum(1)
    return weights / max((weights * mass).sum() / max(mass.sum(), 1e-12), 1e-12)


def _few_tasks(df: DataFrame) -> DataFrame:
    """The table in as many tasks as the cluster has cores at most; each of them gives one partial result."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _counts(assigned: DataFrame, s: Settings, subjects: int) -> np.ndarray:
    """buckets x subjects: documents of each subject that hold the term; `assigned` has subject and sentences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((s.buckets, subjects), dtype=np.int64)
        for batch in batches:
            sentences, subject = batch.column("sentences"), batch.column("subject").to_numpy()
            terms = sentences.flatten().flatten().to_numpy(zero_copy_only=False)
            of_doc = np.diff(sentences.flatten().offsets.to_numpy()[sentences.offsets.to_numpy() - sentences.offsets[0].as_py()])
            doc = np.repeat(np.arange(len(sentences)), of_doc)
            used = np.flatnonzero(np.bincount(terms, minlength=s.buckets))
            if len(sentences) * len(used) <= 60 * len(terms):
                place = np.zeros(s.buckets, dtype=np.int64)
                place[used] = np.arange(len(used))
                holds = np.zeros(len(sentences) * len(used), dtype=bool)
                holds[doc * len(used) + place[terms]] = True
                holds = holds.reshape(len(sentences), len(used))
                for j in np.unique(subject):
                    out[used, j] += holds[subject == j].sum(0)
            else:
                keys = np.unique(doc * s.buckets + terms)
                np.add.at(out, (keys % s.buckets, subject[keys // s.buckets]), 1)
        out = out.reshape(-1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "n"])

    summed = _few_tasks(assigned.select("subject", "sentences")).mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(s.buckets * subjects)
    found[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return found.reshape(s.buckets, subjects)


def _decompose(prepared: DataFrame, model: _Model, s: Settings, before: _Model | None) -> None:
    """Sets the model's basis to the leading right singular vectors of the documents' matrix, going on from the model before."""
    names = [f"v{k}" for k in range(s.rank)]
    schema = "slot int, " + ", ".join(f"{n} double" for n in names)
    rng = np.random.default_rng(s.seed)
    begin = rng.standard_normal((max(len(model.active), s.rank), s.rank))
    if before is not None and len(before.active):
        begin *= 1e-3 / np.sqrt(len(begin))
        shared = model.slot[before.active]
        begin[shared[shared >= 0]] += before.basis[shared >= 0]
    model.basis = np.linalg.qr(begin)[0][: len(model.active)].astype(np.float32)
    if not len(model.active):
        return
    for _ in range(s.passes if before is None else 1):
        sent = prepared.sparkSession.sparkContext.broadcast(model)

        def products(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m: _Model = sent.value
            out = np.zeros((len(m.active), m.s.rank))
            for batch in batches:
                sentence, slot, value, in_doc, n = m.parts(batch.column("sentences"))
                out += m.iterated(in_doc[sentence], slot, value, n)
            used = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(out[used, k]) for k in range(m.s.rank)]], names=["slot", *names])

        summed = _few_tasks(prepared.select("sentences")).mapInArrow(products, schema).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        sent.destroy()
        z = np.zeros((len(model.active), s.rank))
        z[summed.column("slot").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names], axis=1)
        z += 1e-9 * rng.standard_normal(z.shape)
        model.basis = np.linalg.qr(z)[0].astype(np.float32)
        if model.basis.shape[1] < s.rank:  # fewer terms than vectors
            model.basis = np.pad(model.basis, ((0, 0), (0, s.rank - model.basis.shape[1])))


def _centroids(seeded: DataFrame, model: _Model, s: Settings) -> None:
    """Sets the model's centroids from the documents of each subject (columns subject, language, sentences), one for each language."""
    sent = seeded.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: _Model = sent.value
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            sentence, slot, value, in_doc, n = m.parts(batch.column("sentences"))
            e = m.embed(in_doc[sentence], slot, value, n)
            e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-6)
            groups = batch.column("subject").to_numpy() * 100 + batch.column("language").to_numpy()
            for g in np.unique(groups).tolist():
                acc[g] = acc.get(g, 0) + e[groups == g].sum(0)
        flat = [(g // 100, g % 100, k, float(v)) for g, x in acc.items() for k, v in enumerate(x)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["subject", "language", "k", "v"])

    seeds = _few_tasks(seeded.select("subject", "language", "sentences"))
    total = seeds.mapInArrow(sums, "subject int, language int, k int, v double").groupBy("subject", "language", "k").agg(F.sum("v").alias("v"))
    means: dict[tuple[int, int], np.ndarray] = {}
    for r in total.collect():  # subjects x languages x rank
        means.setdefault((r.subject, r.language), np.zeros(s.rank))[r.k] = r.v
    sent.destroy()
    kept = [(j, m / np.linalg.norm(m)) for (j, _), m in sorted(means.items()) if np.linalg.norm(m) > 1e-3]
    model.centroids = np.array([m for _, m in kept], dtype=np.float32).reshape(-1, s.rank)
    model.subject_of = np.array([j for j, _ in kept], dtype=np.int32)


def _judge(m: _Model, sentences: pa.Array, subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cosines, sentences on each subject, all sentences) of each document."""
    sentence, slot, value, in_doc, n = m.parts(sentences)
    each = m.embed(sentence, slot, value, len(in_doc))
    documents = _times(in_doc, np.arange(len(in_doc)), np.ones(len(in_doc), dtype=np.float32), n, each)
    strength = np.sqrt(np.bincount(sentence, weights=value * value, minlength=len(in_doc)))
    on = np.zeros((n, subjects), dtype=np.int64)
    strong = np.flatnonzero(strength > 0.5)
    near = m.subjects(each[strong], subjects)
    told = near.max(1, initial=-1) > 0.3
    if told.any():
        on = np.bincount(in_doc[strong[told]] * subjects + near[told].argmax(1), minlength=n * subjects).reshape(n, subjects)
    return m.subjects(documents, subjects), on, np.bincount(in_doc, minlength=n)


def subject_areas(
    documents: DataFrame, areas: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """(doc_id, subject) of every subject that a document treats.

    `areas` has subject, name and description, `labels` doc_id and subject; codes
    are compared without case, blanks and underscores; labels of unknown codes or
    documents are left out; a document with labels of several subjects is no seed.
    Null and empty texts, and texts without a subject, give no row; repeated rows
    count once; ties at the threshold count as treated. Without any area the result
    is empty.
    """
    s, spark = settings, documents.sparkSession
    scratch = Scratch(spark, "subjects")
    codes = sorted(r.subject for r in areas.select("subject").where("subject is not null").distinct().collect())  # a fixed, small table
    empty = documents.select(F.col(doc).alias("doc_id"), F.lit("").alias("subject")).limit(0)
    if not codes:
        return empty
    n_subjects = len(codes)

    def code_of(column: Column) -> Column:
        return F.regexp_replace(F.lower(column), r"[\s_-]+", "")

    index = F.create_map(*[x for i, c in enumerate(codes) for x in (F.lit(c.lower().replace("_", "").replace("-", "").replace(" ", "")), F.lit(i))])
    prepared = scratch.keep(prepared_texts(documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), s.buckets))
    total = prepared.count()
    if not total:
        return empty
    documents_of = _counts(prepared.select(F.lit(0).alias("subject"), "sentences"), s, 1)[:, 0]

    known = labels.select("doc_id", F.element_at(index, code_of(F.col("subject"))).alias("subject")).where("subject is not null and doc_id is not null")
    single = known.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("other")).where("subject = other").select("doc_id", "subject")
    told = areas.where("subject is not null").select(F.element_at(index, code_of(F.col("subject"))).alias("subject"), F.concat_ws(". ", "name", "description").alias("text"))
    described = prepared_texts(told, s.buckets)
    labelled = scratch.keep(prepared.join(single, "doc_id").select("subject", "language", "sentences"))
    seeds = labelled.unionByName(described)
    by_subject = _counts(seeds, s, n_subjects)
    model = None
    for k in range(s.rounds):
        before, model = model, _Model(s, _weights(documents_of, total, by_subject, s))
        _decompose(prepared, model, s, before)
        _centroids(seeds, model, s)
        sent = spark.sparkContext.broadcast(model)
        if k + 1 == s.rounds:
            break

        def plain(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m: _Model = sent.value
            for batch in batches:
                cosines, on, _ = _judge(m, batch.column("sentences"), n_subjects)
                order = np.sort(cosines, axis=1)
                best = cosines.argmax(1)
                second = order[:, -2] if n_subjects > 1 else np.full(len(order), -1.0)
                sure = (order[:, -1] >= m.s.plain) & (second < m.s.similarity) & (on[np.arange(len(on)), best] >= 2)
                yield pa.RecordBatch.from_arrays([pa.array(best[sure].astype(np.int32)), *[batch.column(c).filter(pa.array(sure)) for c in ("language", "sentences")]], names=["subject", "language", "sentences"])

        assigned = scratch.keep(prepared.select("language", "sentences").mapInArrow(plain, "subject int, language int, sentences array<array<int>>"))
        # A subject without plain documents in a language keeps its labelled ones in it.
        held = assigned.select("subject", "language").distinct()  # subjects x languages
        kept = labelled.join(F.broadcast(held), ["subject", "language"], "left_anti")
        seeds = assigned.unionByName(kept).unionByName(described)
        by_subject = _counts(seeds, s, n_subjects)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: _Model = sent.value
        for batch in batches:
            cosines, on, sentences = _judge(m, batch.column("sentences"), n_subjects)
            treated = (cosines >= m.s.similarity) & ((on >= 2) | ((on >= 1) & (sentences[:, None] <= 2)))
            rows, which = np.nonzero(treated)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array([codes[j] for j in which], pa.string())], names=["doc_id", "subject"])

    kind = prepared.schema["doc_id"].dataType.simpleString()
    return prepared.mapInArrow(final, f"doc_id {kind}, subject string").distinct()
