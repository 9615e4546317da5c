import pytest
from pyspark.sql import functions as F

from tessera.functions import geocells, hashes, text
from tessera.functions.embedding import cut_at_space
from tessera.operators import fts_index, indexes, search, storage
from tessera.streaming import state

ARTICLES = [("1", "Apple pie", "a pie of apples", "the apple and the pie", "work"), ("2", "Pear", None, "no fruit but a pear", "work"), ("3", "", "", None, "place"), ("4", "Apples", "x", "apple apple", "person")]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "id string, title string, description string, content string, type string")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_cells(spark):
    assert one(spark, F.col("id") * 0 + 1) == 1
    b = one(spark, geocells.bounds(F.lit("9q8yyk"), 6))
    assert b["south"] <= 37.7749 <= b["north"] and b["west"] <= -122.4194 <= b["east"]
    n = one(spark, geocells.neighbours(F.lit("9Q8"), 3))
    assert sorted(n.asDict().values()) == sorted(["9qb", "9r0", "9qc", "9r1", "9q2", "9q3", "9q9", "9qe"]) or "9q9" in n.asDict().values()
    assert one(spark, geocells.neighbours(F.lit("z"), 1))["n"] == "" and one(spark, geocells.neighbours(F.lit("z"), 1))["e"] == ""
    cells = one(spark, geocells.cells_of_circle(F.lit(37.7749), F.lit(-122.4194), 1.0, 6))
    assert cells == ["9q8yyk"]
    box = one(spark, geocells.radius_box(F.lit(0.0), F.lit(179.9), F.lit(100_000.0)))
    assert box["west"] > box["east"]
    assert one(spark, geocells.radius_box(F.lit(89.9), F.lit(0.0), F.lit(100_000.0)))["west"] == -180


def test_radius_join(spark):
    """Across the antimeridian and around a pole, by brute force; points without coordinates take no part."""
    rows = [(i, float((i * 37) % 181 - 90), float((i * 101) % 361 - 180)) for i in range(300)] + [(1000, None, 3.0), (1001, 89.5, -170.0), (1002, 0.0, 179.99), (1003, 0.0, -179.99)]
    p = spark.createDataFrame(rows, "id long, lat double, lng double")
    c = p.where("lat is not null").withColumnRenamed("id", "centre")
    got = {(r["centre"], r["id"]) for r in geocells.radius_join(c, p, 900_000.0).collect()}
    far = geocells.haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    want = {(r["centre"], r["id"]) for r in c.join(p.toDF("id", "p_lat", "p_lng"), F.lit(True)).where(far <= 900_000.0).collect()}
    assert got == want and (1002, 1003) in got
    with pytest.raises(ValueError):
        geocells.nearby(p, 91, 0)
    with pytest.raises(ValueError):
        geocells.nearby(p, 0, 0, 501)


def test_positions(spark, articles):
    got = {(r["id"], r["field"], r["term"]): r["positions"] for r in search.postings(articles, stem=False).collect()}
    assert got["1", "content", "apple"] == [1] and got["1", "content", "pie"] == [4]
    stems = {(r["id"], r["field"], r["term"]): r["tf"] for r in search.postings(articles).collect()}
    assert stems["1", "title", "appl"] == 1 if ("1", "title", "appl") in stems else stems["1", "title", "apple"] == 1


def test_stored_index(spark, articles, tmp_path):
    """A stored index ranks as the texts do, after additions, replacements and removals too."""
    a, b, c = (str(tmp_path / x) for x in "abc")
    key = lambda df: [(r["id"], round(r["score"], 9), r["matched"]) for r in df.collect()]
    fts_index.build(articles, a, buckets=4)
    assert key(fts_index.search(spark, a, "apples pie", buckets=4)) == key(search.bm25(articles, "apples pie")) != []
    assert key(fts_index.search(spark, a, "apples", buckets=4, types=["person"])) == key(search.bm25(articles, "apples", types=["person"]))
    changed = spark.createDataFrame([("2", "Apple", "", "apple pear", "work")], articles.schema)
    fts_index.added(spark, a, changed, b, buckets=4)
    after = articles.where("id <> '2'").union(changed)
    assert key(fts_index.search(spark, b, "apple pear", buckets=4)) == key(search.bm25(after, "apple pear"))
    fts_index.removed(spark, b, after.where("id = '1'"), c, buckets=4)
    assert key(fts_index.search(spark, c, "apple", buckets=4)) == key(search.bm25(after.where("id <> '1'"), "apple"))
    assert fts_index.search(spark, c, "", buckets=4).count() == 0


def test_letters_that_change_class(spark):
    rows = spark.createDataFrame([("İstanbul and ȺB Kelvin x",)], "t string")
    got = rows.select(text.words(F.col("t")).alias("w")).first()["w"]
    assert "and" in got and "ab" not in got


def test_hashes(spark):
    names = ["", "abc", "Ünï", "😀x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", hashes.djb2_32(F.col("n")).alias("d"), hashes.fnv1a_32(F.col("n")).alias("f")).collect():
        h, d = 2166136261, 5381
        units = r["n"].encode("utf-16-le")
        for i in range(0, len(units), 2):
            u = int.from_bytes(units[i : i + 2], "little")
            h, d = (h ^ u) * 16777619 % 2**32, (d * 33 + u) % 2**32
        assert (r["d"], r["f"]) == (d, h)
    assert hashes.fnv1a_32_rounded("a") == int(float(((2166136261 ^ 97) - 2**32)) * 16777619.0) % 2**32
    assert len(hashes.term_positions("abc", 5, 1000)) == 5


def test_lookup_through_filter(spark):
    index = spark.createDataFrame([(f"title {i}", i, "work") for i in range(0, 50, 2)], "key string, id long, type string")
    asked = spark.createDataFrame([(f"Title {i}",) for i in range(50)] + [(None,)], "title string")
    got = {r["title"]: r["id"] for r in indexes.looked_up(asked, index, 50).collect()}
    assert got == {f"Title {i}": (i if i % 2 == 0 else None) for i in range(50)} | {None: None}


def test_cut_at_space(spark):
    cut = lambda s, n, back: one(spark, cut_at_space(F.lit(s), n, back))
    assert cut("abc", 8, 5) == "abc" and cut("aaaa bbbb cccc", 11, 5) == "aaaa bbbb" and cut("aaaaaaaaaaaaa", 5, 3) == "aaaaa" and cut("a bbbbbbbbbb", 10, 3) == "a bbbbbbbb"


def test_pages_and_batches(spark):
    df = spark.range(95)
    page = storage.paged(df, [F.col("id")], 500, -3)
    rows = page.collect()
    assert [r["id"] for r in rows] == list(range(20)) and rows[0]["total"] == 95 and rows[0]["has_more"]
    got = storage.batched(df.repartition(5), [F.col("id")], 10).orderBy("batch").collect()
    assert [[x["id"] for x in r["items"]] for r in got] == [list(range(i, min(i + 10, 95))) for i in range(0, 95, 10)]


def test_attributes(spark):
    assert one(spark, storage.attributes(F.lit('<a x="1" y="2" x="3">'))) == {"x": "3", "y": "2"} and one(spark, storage.attributes(F.lit("<a>"))) == {}
    assert [one(spark, storage.codec_of(F.lit(p))) for p in ("a.XML.BZ2", "b.gzip", "c")] == ["bzip2", "gzip", "auto"]


def test_folds_in_small_batches(spark):
    """A key's state goes on from batch to batch; keys, a null one too, do not mix."""
    rows = [(k, t, i) for k in ("a", "b", None) for i, t in enumerate([0, 10, 20, 30, 1000, 1005, 1010])]
    df = spark.createDataFrame(rows, "k string, t long, o int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = state.rate_limited(df, "k", "t", "o", limit=2, window_ms=100).collect()
        fixed = state.rate_limited_fixed(df, "k", "t", "o", limit=2, window_ms=100).collect()
        states = state.breaker_states(df.withColumn("ok", F.lit(False)), "k", "t", "ok", "o").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("a", "b", None):
        mine = lambda x: [r for r in sorted((r for r in x if r["k"] == k), key=lambda r: r["o"])]
        assert [r["allowed"] for r in mine(got)] == [True, True, False, False, True, True, False]
        assert [r["allowed"] for r in mine(fixed)] == [True, True, False, False, True, True, False]
        assert [r["state"] for r in mine(states)] == ["closed"] * 4 + ["open"] * 3


def test_variants():
    assert text.variants_of("Café bars") == ["cafe bars", "cafe bar", "café bars", "cafe", "bars"]
