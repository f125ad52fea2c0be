"""Encoding of a corpus with a public byte-level BPE vocabulary, cut at forced boundaries.

A pair of bytes that stands nowhere inside a token of the vocabulary can never be
merged, so each place where such a pair meets is certain to be a token boundary.
The texts of an Arrow batch are cut at those places in one vectorised pass over
their bytes; the fragments (mostly single words) are encoded independently, each
distinct one once and then from a cache, and their ids are put together again.

Two kinds of forced places are no cuts, since the pre-tokenizer looks across them:
behind white space (its last character goes with what follows) and before an
apostrophe (it could begin a contraction only at the start of a piece).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def forced_pairs(vocabulary: dict[str, int]) -> np.ndarray:
    """256 x 256 booleans: true where no token holds the two bytes side by side."""
    byte = _byte_of_char()
    free = np.ones((256, 256), dtype=bool)
    for token in vocabulary:
        b = [byte[c] for c in token if c in byte]
        if len(b) == len(token):
            free[b[:-1], b[1:]] = False
    return free


def cut_places(data: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The places in UTF-8 bytes before which a text may be cut (see the module's text)."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    left, right = data[:-1], data[1:]
    cut = free[left, right] & ((right & 0xC0) != 0x80) & (right != 0x27)
    cut &= ~((left == 0x20) | ((left >= 0x09) & (left <= 0x0D)) | ((left >= 0x1C) & (left <= 0x1F)))
    places = np.flatnonzero(cut) + 1
    wide = places[data[places - 1] >= 0x80]
    if len(wide):
        last, before = data[wide - 1], data[np.maximum(wide - 2, 0)]
        # Two- and three-byte white space: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
        space = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
        first = data[np.maximum(wide - 3, 0)]
        space |= (first == 0xE2) & ((before == 0x80) | (before == 0x81))
        space |= ((first == 0xE1) & (before == 0x9A)) | ((first == 0xE3) & (before == 0x80))
        places = np.setdiff1d(places, wide[space], assume_unique=True)
    return places


class Encoder:
    """Encodes Arrow arrays of texts; one for each Python worker."""

    def __init__(self, vocabulary: str, cached: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.free = forced_pairs(json.loads(Path(vocabulary).read_text())["model"]["vocab"])
        self.cache: dict[bytes, list[int]] = {}
        self.cached = cached

    def encode(self, texts: pa.Array) -> pa.Array:
        """LIST<INT32> of each text; a null or empty text gives an empty list."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        places = cut_places(np.frombuffer(data, dtype=np.uint8), self.free)
        bounds = np.unique(np.concatenate([places, ends]))
        raw, at = bytes(data), bounds.tolist()
        fragments = [raw[a:b] for a, b in zip(at, at[1:])]
        if len(self.cache) > self.cached:
            self.cache.clear()
        cache = self.cache
        missing = [f for f in set(fragments) if f not in cache]
        for f, e in zip(missing, self.tokenizer.encode_batch([f.decode() for f in missing], add_special_tokens=False)):
            cache[f] = e.ids
        ids = [cache[f] for f in fragments]
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32)
        before = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(before[np.searchsorted(bounds, ends)]), pa.array(flat))


def encode_column(rows: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): the token ids of each row's text by the vocabulary file, without special tokens.

    Names of special tokens inside a text are plain text. Null and empty texts give
    an empty list; repeated rows and null keys are kept as they are; other columns
    are not read. An empty table gives an empty result. No shuffle.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in it:
            encoder = encoder or Encoder(vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], names=[key, "ids"])

    kept = rows.select(F.col(key), F.col(text).cast("string").alias("text_"))
    return kept.mapInArrow(batches, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")
