import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import classify, embedding, filters, logs, vectors
from tessera.operators import clusters, graph, search, storage
from tessera.plans import more
from tessera.plans.catalog import QUERIES, SQL
from tessera.streaming.state import admit_fixed

D = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == more.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name not in SQL:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "nation", "region", "part", "orders"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
    at = [want.columns.index(c) for c in cols]
    assert sorted((key(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((key(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_classifier_text_and_names(spark):
    rows = [(1, "scientist", [], ""), (2, None, None, "He was an american actor."), (3, None, ["1990 in music"], ""), (4, None, [], "born\n1990"), (5, None, None, None), (6, None, [], "He saw her. They left.")]
    df = spark.createDataFrame(rows, "id int, box string, c array<string>, t string")
    names = {"person": ["scientist"]}
    of = lambda n: [r[0] for r in df.orderBy("id").select(classify.article_type(F.col("box"), F.col("c"), F.col("t"), n)).collect()]
    assert of(names) == ["person", "person", "event", "other", "other", "person"]
    assert of(None)[0] == "other"
    assert df.orderBy("id").select(classify.confidence(F.col("box"), names)).first()[0] == "high"


def test_logs(spark):
    good = '{"outcome": "ok", "logs": [], "exceptions": []}'
    got = spark.createDataFrame([(good,), ('{"outcome": "ok"}',), ("no",), (None,)], "raw string").select(logs.parsed_events(F.col("raw")).isNotNull()).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    assert logs.glob_regex("a.b/*?") == r"^a\.b/.*.\z"
    b = spark.createDataFrame([([], 0), ([(1.0, 0), (2.0, 4)], 8)], "b array<struct<le double, count long>>, n long")
    assert [r[0] for r in b.select(logs.bucket_percentile(F.col("b"), F.col("n"), 0.25)).collect()] == [0.0, 1.5]
    assert b.limit(1).select(logs.health(F.lit("closed"), F.lit(0), F.lit(0))).first()[0] == "healthy"


def test_embedding_failures(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return np.ones((len(texts), 2))

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1)
    got = {r["t"]: (r["embedding"], r["embed_error"]) for r in embedding.with_embeddings(df, "t", embed).collect()}
    assert got == {"a": ([1.0, 1.0], None), "bad": (None, "ValueError: bad"), None: (None, None)}
    table = embedding.with_embeddings(df.where("t = 'a'"), "t", embed)
    found = {r["t"]: (r["hit"], r["embedding"]) for r in embedding.embedded_terms(df.where("t is not null"), table, embed, "t").collect()}
    assert found == {"a": (True, [1.0, 1.0]), "bad": (False, None)}
    a = spark.createDataFrame([(1, "A b", ["C"], {"name": "Dee", "city": "x"}), (2, None, None, None)], "id int, title string, categories array<string>, infobox map<string,string>")
    assert sorted((r["normalized"], r["source"]) for r in embedding.extracted_terms(a).collect()) == [("a b", "title"), ("c", "category"), ("dee", "entity")]


def test_vector_indexes(spark):
    v = spark.read.parquet(f"{D}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id = 3").first()["embedding"]
    exact = [r["id"] for r in v.select("id", vectors.squared_l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("x")).orderBy("x", "id").limit(10).collect()]
    codes = clusters.ProductCodes(v, parts=16, words=64)
    found = [r["id"] for r in codes.search(v.withColumn("codes", codes.codes(F.col("embedding"))), q, 10).collect()]
    assert found[0] == 3 and len(set(found) & set(exact)) >= 6
    pc = clusters.principal_components(v, 4)
    assert np.allclose(pc @ pc.T, np.eye(4), atol=1e-6)
    with pytest.raises(ValueError):
        clusters.ProductCodes(v, parts=7)
    r = spark.range(1).select(vectors.quantised_cosine(F.array(F.lit(128)), F.array(F.lit(0))).alias("z"), vectors.min_max_quantised(F.array(F.lit(2.0), F.lit(2.0))).alias("m")).first()
    assert r["z"] == 0 and r["m"] == [0, 0]


def test_edges_and_storage(spark, tmp_path):
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "id int, title string")
    links = spark.createDataFrame([(1, "links_to", "b"), (2, "born_in", "a"), (1, "links_to", "zz")], "from_id int, predicate string, to_title string")
    forward = graph.forward_edges(links, titles)
    reverse = graph.reverse_edges(forward, titles)
    got = [(r["direction"], r["predicate"], r["other_id"]) for r in graph.relationships(forward, reverse, 1).collect()]
    assert got == [("outgoing", "links_to", 2), ("incoming", "birthplace_of", 2)]
    assert graph.relationships(forward, reverse, 1, predicate="born_in").count() == 0
    with pytest.raises(ValueError):
        graph.relationships(forward, reverse, 1, direction="up")
    graph.write_edges(forward, str(tmp_path / "e"), "from_id")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    assert storage.file_level(10) is None and storage.file_level(80_000) == "warning" and storage.file_level(95_000) == "critical"
    with pytest.raises(ValueError):
        storage.file_level(100_000)
    m = spark.createDataFrame([("person", 2, 1, 10)], "type string, rows long, files long, bytes long")
    assert tuple(storage.merged_manifests([m, m]).first()) == ("person", 4, 2, 20)
    with pytest.raises(ValueError):
        storage.merged_manifests([])
    storage.write_index(titles, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).count() == 2
    assert [r[0] for r in storage.as_lines(spark.createDataFrame([('a"b', 0.5), (None, None)], "t string, s double"), "csv").collect()] == ['"a""b",0.5000', ","]
    posts = spark.createDataFrame([(1, "x"), (2, "x")], "id int, term string")
    assert [r["id"] for r in search.without(posts, titles.where("id = 2")).collect()] == [1]


def test_cursor_and_windows():
    assert filters.offset_of(filters.cursor(40)) == 40 and filters.offset_of("?") == 0 and filters.offset_of("W10=") == 0
    assert filters.page_info(30, 20, 0)["has_more"] and not filters.page_info(30, 20, 20)["has_more"]
    assert admit_fixed([0, 1, 2, 10, 11], None, 0, 2, 10) == ([True, True, False, True, True], 10, 2)
