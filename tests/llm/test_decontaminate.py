import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.decontaminate import FAR, Matcher, aligned, banded, edits, find_benchmark, gram_length, letters_of, op6_decontamination, without_benchmark

D = "/root/testdata/sf0.001"


def least(item, text):
    """Edits of the best stretch of the text, by the whole table."""
    text = np.array(list(text)) if isinstance(text, str) else np.array(text)
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (text != c)))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def edited(rng, word, k):
    word = list(word)
    for _ in range(k):
        at, how = int(rng.integers(len(word))), int(rng.integers(3))
        if how == 0:
            word[at] = "z"
        elif how == 1:
            word.insert(at, "z")
        else:
            del word[at]
    return "".join(word)


@pytest.mark.parametrize("size", [15, 17, 20, 30, 34, 60, 150, 600])
def test_planted_edits(size):
    """Copies with 0 to k edits are found wherever they stand, with no more edits than planted; strangers are not."""
    rng = np.random.default_rng(size)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxy"), n))
    items = [letters(size) for _ in range(4)]
    k = edits(size, 0.06)
    m = Matcher(list(range(4)), [letters_of(pa.array([i]))[0] for i in items], 0.06, gram_length(size, 0.06, 12))
    texts, want = [], []
    for n, item in enumerate(items):
        for planted in sorted({0, min(1, k), k // 2, max(0, k - 1), k}):
            texts.append(letters(int(rng.integers(0, 90))) + edited(rng, item, planted) + letters(int(rng.integers(0, 90))))
            want.append((n, planted))
    texts += [letters(200) for _ in range(8)]
    found = {}
    for doc, n, start, end, e in m.find(pa.array(texts)):
        found.setdefault(doc, {})[n] = (start, end, e)
    for doc, (n, planted) in enumerate(want):
        start, end, e = found[doc][n]
        assert e <= planted and e == least(items[n], texts[doc]) and least(items[n], texts[doc][start:end]) == e
    for doc in range(len(texts)):
        for n in range(4):
            assert (n in found.get(doc, {})) == (least(items[n], texts[doc]) <= k)


@pytest.mark.parametrize("seed", range(5))
def test_band(seed):
    """On all diagonals the band is the whole table."""
    rng = np.random.default_rng(seed)
    item, text = rng.integers(97, 100, 12).astype(np.uint8), rng.integers(97, 100, 40).astype(np.uint8)
    low, high = -len(item), len(text)
    d = np.arange(low, high + 1)
    assert banded(item, text, low, high, np.where((d >= 0), 0, FAR)).min() == least(item.tolist(), text.tolist())
    got = aligned(item, text, 12, 0, len(text) - len(item))
    assert got and least(item.tolist(), text[got[1] : got[2]].tolist()) == got[0]


def test_query(spark):
    """Exact copies, by search in the plain letters."""
    docs, bench = (spark.read.parquet(f"{D}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: bytes(letters_of(pa.array([t]))[0])
    items = {r["item_id"]: plain(r["text"]) for r in bench}
    want = {(r["doc_id"], i) for r in docs for i, t in items.items() if t in plain(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in op6_decontamination(spark, D).collect() if r["edits"] == 0}
    assert got == want


def test_small_blocks(spark):
    docs, bench = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(find_benchmark(docs, bench, block_bytes=4000)) == key(find_benchmark(docs, bench))
    assert without_benchmark(docs.limit(0), bench).count() == 0 and find_benchmark(docs.limit(0), bench).count() == 0
