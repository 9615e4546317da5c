import pytest

from tessera.llm.jaccard import jaccard_components

WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("options", [{}, {"region_docs": 1, "task_shingles": 10}])
def test_repeated_rows(spark, options):
    """One result row for each row, where a document that is not the least of its component is repeated."""
    rows = [(1, WORDS), (2, WORDS + " x"), (2, WORDS + " x"), (2, WORDS + " x"), (3, "a b c d")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, **options)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 3)]


def test_one_id_with_two_texts(spark):
    """Rows of one id are one node: what either text reaches is one component."""
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, WORDS), (2, other), (4, WORDS + " x"), (4, other + " x")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (4, 1), (4, 1)]
