import public_tokenizers as P
from tokenizers import Tokenizer

from tessera.llm.tokencount import WordCounter, count_tokens

SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()


def test_words_of_white_space():
    """A word that is a space only and one with a space inside make up for each other in the number of fields."""
    lib, counter = Tokenizer.from_str(SPEC), WordCounter(SPEC)
    for words in (["x1", "\xa0", "ab,", "c-d-e-f", "10\xa0000", "z9"], ["10\u3000000", "c-d-e-f", "ab,", "\u2003", "z9"]):
        want = [len(lib.encode(w, add_special_tokens=False).ids) for w in words]
        assert counter.count([w.encode() for w in words]).tolist() == want


def test_documents_with_white_space(spark):
    lib = Tokenizer.from_str(SPEC)
    rows = [(1, "x1 \xa0 ab, c-d-e-f"), (2, "c-d-e-f z9"), (3, "10\xa0000 ab,")]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_no_other_character_becomes_a_space():
    normal = WordCounter(SPEC).library.normalizer.normalize_str
    text = [c for c in map(chr, [*range(0x21, 0xD800), *range(0xE000, 0x30000)]) if not c.isspace()]
    for at in range(0, len(text), 1000):
        assert " " not in normal("x".join(text[at : at + 1000]))
