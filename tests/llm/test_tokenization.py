import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.tokenization import VOCABULARIES, Encoder, encode_column

VOCABULARY = f"{VOCABULARIES}/byte_bpe_50k.json"
ENCODER = Encoder(VOCABULARY)


def whole(texts):
    return [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


pieces = st.sampled_from(
    ["a", "é", "ß", "'", "'s", "'ll", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", " ", "\x1c", "!", "§", "1",
     "½", "中", "文", "😀", "<|endoftext|>", ".", "x'", "​", "́", "I", "don't", "\r\n", "\x00", "᠎"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.lists(pieces, max_size=14).map("".join), st.text(max_size=20)), min_size=1, max_size=4))
def test_same_as_whole_texts(texts):
    assert ENCODER.encode(pa.array(texts)).to_pylist() == whole(texts)


def test_slices_nulls_long_texts():
    long = "wörd " * 50_000 + "x" * 30_000
    texts = pa.array(["skip", None, "", " ", long, "end"]).slice(1)
    assert ENCODER.encode(texts).to_pylist() == [[], [], *whole([" ", long, "end"])]
    assert len(ENCODER.encode(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("n", [0, 3])
def test_frame(spark, n):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 6), (None, None, 7)][:n]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_column(df, "doc_id", "text", VOCABULARY).collect())
    assert got == [(0, []), *[(1, whole(["Hello  world"])[0])] * 2][:n]
