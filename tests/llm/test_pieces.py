import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from tessera.llm.pieces import TextEncoder, encode_pieces, load_pieces, model_type

FILE = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=FILE)
ENCODER = TextEncoder(load_pieces(FILE))


def ids_of(texts):
    ids, ends = ENCODER.encode(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_model_type():
    assert model_type(open(FILE, "rb").read()) == 2 and model_type(b"") == 1


@pytest.mark.parametrize("text", ["▁ ", "▁", " ▁", "a▁b", "▁▁a ▁ b▁", "x▁ \n▁y"])
def test_marks(text):
    assert ids_of([text]) == [LIB.encode(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the▁  \n\tÄ😀.,1"), max_size=40) | st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), max_size=4))
def test_as_the_library(texts):
    assert ids_of(texts) == [LIB.encode(t) for t in texts]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert encode_pieces(docs, ENCODER.model).count() == 0
