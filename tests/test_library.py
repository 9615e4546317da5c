import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, hashes, text, wikitext
from tessera.functions.filters import run_query
from tessera.operators import search, storage
from tessera.plans.catalog import QUERIES, SQL
from tessera.sources.readers import read_dump
from tessera.streaming.state import admit_sliding, breaker, event_windows

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["articles_from_documents", "export_index", "filter_ne", "filter_contains", "request_rollup", "fts_bm25", "knn_cosine", "hybrid_rrf", "geo_radius", "wiki_infobox"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "customer", "nation", "region", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df, want = QUERIES[name](spark, D), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
    at = [want.columns.index(c) for c in cols]
    assert sorted((key(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((key(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_text():
    assert text.normalised_term("it's a test") == "it s a test"
    assert text.normalised_term("C++ programming") == "c programming"
    assert text.porter_step1("running") == "run" and text.porter_step1("hoping") == "hope" and text.porter_step1("caresses") == "caress" and text.porter_step1("happy") == "happi"
    assert text.jaro_winkler_of("abcx", "ayyz") == pytest.approx(0.55)
    assert text.jaro_winkler_of("", "a") == 0 and text.jaro_winkler_of("", "") == 1
    assert hashes.djb2("a") == 177670 and hashes.fnv1a(b"") == 0xCBF29CE484222325 and hashes.bloom_size(1000, 0.01) == (9586, 7)


def test_string_columns(spark):
    r = spark.createDataFrame([("Foo_bar  Baz", "category:x", "[[paris|P]]", "ponies")], "a string, b string, c string, d string").select(text.title_key(F.col("a")).alias("a"), text.wiki_title(F.col("b")).alias("b"), text.place(F.col("c")).alias("c"), text.stemmed_suffix(F.col("d")).alias("d")).first()
    assert tuple(r) == ("foo bar baz", None, "Paris", "pony")


def test_geo(spark):
    r = spark.range(1).select(geo.geohash(F.lit(37.7749), F.lit(-122.4194)).alias("g"), (geo.haversine(F.lit(37.7749), F.lit(-122.4194), F.lit(34.0522), F.lit(-118.2437)) / 1000).alias("km")).first()
    assert r["g"] == "9q8yyk" and 550 < r["km"] < 570
    assert geo.decoded("9q8yyk")[0] == pytest.approx(37.7749, abs=0.01)
    with pytest.raises(ValueError):
        geo.decoded("a")


def test_query_language(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "Xy", 7)], "id int, name string, n int")
    ids = lambda *f, **k: [r["id"] for r in run_query(df, list(f), **k).collect()]
    assert ids({"field": "name", "operator": "ne", "value": "x"}) == [2, 3]
    assert ids({"field": "name", "operator": "eq", "value": None}) == [2]
    assert ids({"field": "n", "operator": "gt", "value": 5}) == [3]
    assert ids({"field": "n", "operator": "eq", "value": "5"}) == []
    assert ids({"field": "name", "operator": "starts_with", "value": "X"}) == [1, 3]
    assert ids(order_by="n", order_dir="desc") == [3, 2, 1]
    with pytest.raises(ValueError):
        ids({"field": "n", "operator": "like", "value": 1})


def test_wikitext(spark):
    t = "{{Infobox Scientist\n| name = {{nowrap|A|B}}\n| place = [[X|Y]]\n}}\n'''A''' [[Foo#s|bar]] [[foo]] [[File:x.png]]\n== Life ==\nText\n[[Category:P|key]]"
    r = spark.createDataFrame([(t,)], "w string").select(wikitext.parse("w").alias("p"), wikitext.links(F.col("w")).alias("l"), wikitext.categories(F.col("w")).alias("c")).first()
    assert r["p"]["infobox_type"] == "scientist" and r["p"]["infobox"]["place"] == "[[X|Y]]" and r["p"]["infobox"]["name"] == "{{nowrap|A|B}}"
    assert [x["page"] for x in r["l"]] == ["X", "Foo"] and r["c"] == ["P"] and r["p"]["sections"][1]["title"] == "Life"


def test_dump_and_storage(spark, tmp_path):
    page = "<page><title>T{0}</title><ns>{1}</ns><id>{0}</id><revision><id>9</id><timestamp>2024-01-01T00:00:00Z</timestamp><text>a &amp; b</text></revision></page>"
    (tmp_path / "d.xml").write_text("<m>" + page.format(1, 0) + page.format(2, 1) + "</m>")
    rows = read_dump(spark, str(tmp_path / "d.xml")).collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "a & b")]
    df = spark.createDataFrame([(1, "person"), (2, "place"), (3, "person")], "id int, type string")
    storage.write_partitioned(df, str(tmp_path / "out"))
    got = {r["type"]: r["rows"] for r in storage.manifest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"person": 2, "place": 1}
    with pytest.raises(Exception, match="unknown type"):
        storage.write_partitioned(df.withColumn("type", F.lit("?")), str(tmp_path / "bad"))


def test_fts(spark):
    a = spark.createDataFrame([("1", "Red apples", "", "apples are red"), ("2", "Pears", "", "a pear")], "id string, title string, description string, content string")
    assert [r["id"] for r in search.bm25(a, "apple").collect()] == ["1"] and search.bm25(a, "").count() == 0


def test_state(spark):
    assert admit_sliding([0, 1, 2, 10], [], 2, 10) == [True, True, False, True]
    assert breaker([(i, False) for i in range(5)] + [(40_000, True), (40_001, True), (40_002, True)])[4:] == ["open", "half-open", "half-open", "closed"]
    events = spark.read.parquet(f"{D}/events.parquet")
    assert event_windows(events, "ts", "1 day").agg(F.sum("n")).first()[0] == events.count()
