"""Queries whose results or tasks went wrong on larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import tessera.plans.more  # noqa: F401  adds its queries to the catalog
import tessera.plans.wider  # noqa: F401
from tessera.functions import geocells, hashes, text
from tessera.operators import fts_index, search, storage
from tessera.plans.catalog import QUERIES, SQL


@pytest.fixture
def settings(spark):
    """Sets options of the session and puts back the old ones."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_batches_of_wide_rows(spark, settings, tmp_path):
    """The ranges of the rows are not those of the counts, as counts are narrower and meet in fewer partitions."""
    settings("spark.sql.shuffle.partitions", "40")
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).repartition(7).write.parquet(str(tmp_path / "rows"))
    got = storage.batched(spark.read.parquet(str(tmp_path / "rows")), [F.col("id")], 64).select("batch", F.transform("items", lambda x: x["id"]).alias("i")).orderBy("batch").collect()
    assert [(r["batch"], r["i"]) for r in got] == [(b, list(range(64 * b, min(64 * b + 64, 20_000)))) for b in range(313)]


@pytest.mark.parametrize("name", ["sliding_arrivals", "fixed_window_admission", "hourly_snapshot", "error_ring", "session_windows"])
def test_no_zone_in_event_times(spark, settings, tmp_path, name):
    """Hours that the session's zone skips or repeats are hours of the events."""
    settings("spark.sql.session.timeZone", "America/New_York")
    con = duckdb.connect()
    con.sql(f"""copy (select i as event_id, case when i % 50 = 0 then null else timestamp '2024-03-09 00:00:00.0005' + i * interval 97 second + (i % 2) * interval 239 day end as ts,
     i % 5 as user_id, 'error' as event_type, 1.0 as value, '{{}}' as props from range(4000) r(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'" + (" where ts is not null" if name != "sliding_arrivals" else ""))
    con.sql(f"copy (select * from events) to '{tmp_path}/kept.parquet' (format parquet)")
    (tmp_path / "kept.parquet").replace(tmp_path / "events.parquet")
    df, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want.project(", ".join(df.columns)).fetchall()))


def test_words_that_cancel_out(spark, tmp_path):
    """The signed places of "bi" and "ho" are the same with opposite signs."""
    con = duckdb.connect()
    con.sql(f"copy (select * from (values (1::bigint, 'bi ho'), (2, 'Ho bi.\n\nx'), (3, 'many other words'), (4, '--'), (5, null)) v(doc_id, text), (select 'en' as lang, 's' as source, 9::bigint as n_chars)) to '{tmp_path}/documents.parquet' (format parquet)")
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert sorted(tuple(r) for r in QUERIES["embedded_articles"](spark, str(tmp_path)).collect()) == sorted(con.sql(SQL["embedded_articles"]).fetchall())


TEXTS = ["The Cat_sat, on 2 mats", "İstanbul and ȺB Kelvin x", "naïve façade × ÷ ß", "a–b — “quoted” naïve", "ĀB āc Ḁẞ", "KK Ångström", "x" * 51 + " " + "y" * 50, "tab\tnbsp x1\u0085zz\x1cqq", "", "ΣΑΣ abc ΣΑ", "日本語 go", "ǅungla", "áb ªº µm"]


def test_words_in_workers(spark):
    """Python workers cut texts into the words that the column expression gives."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string")
    assert [r["w"] for r in df.select("i", text.words(F.col("t")).alias("w")).orderBy("i").collect()] == [text.words_of(x) for x in TEXTS]


def test_texts_are_cut_in_workers(spark):
    """Rankings and vocabularies leave no text to be cut by interpreted column expressions."""
    a = spark.createDataFrame([("1", x, None, x) for x in TEXTS], "id string, title string, description string, content string")
    for df in (search.bm25(a, "cat naïve"), search.vocabulary(a), search.corpus_stats(a)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "regexp_extract_all" not in plan


def test_index_is_inverted_where_it_is_read(spark, tmp_path, monkeypatch):
    """No posting is shuffled, segments end with few words, positions stay, and an empty index can be read."""
    monkeypatch.setattr(fts_index, "WORDS", 5)
    a = spark.createDataFrame([(str(i), x, None, f"the {x} cat") for i, x in enumerate(TEXTS * 40)], "id string, title string, description string, content string").repartition(2).localCheckpoint()
    assert "Exchange" not in fts_index.indexed(a, False)._jdf.queryExecution().executedPlan().toString()
    one, two, none = (str(tmp_path / x) for x in ("one", "two", "none"))
    fts_index.build(a, one, stem=False, buckets=4)
    fts_index.removed(spark, one, a.where("cast(id as int) % 3 = 0"), two, buckets=4)
    rows, docs = fts_index.read(spark, two)
    assert rows.select("segment").distinct().count() > 2
    got = rows.select("segment", "term", F.explode(F.arrays_zip("ords", "fields", "tfs")).alias("p")).select("segment", "term", F.col("p.ords").alias("ord"), "p.fields", "p.tfs").join(docs, ["segment", "ord"])
    posts = search.postings(a.where("cast(id as int) % 3 <> 0"), stem=False)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    fields = F.element_at(F.array(F.lit("title"), F.lit("description"), F.lit("content")), F.col("fields").cast("int") + 1)
    assert key(got.select("id", fields, "term", "tfs")) == key(posts.select("id", "field", "term", "tf"))
    assert rows.agg(F.sum(F.size("positions")), F.sum(F.aggregate("positions", F.lit(0), lambda s, x: s + x))).first() == posts.select(F.explode("positions").alias("x")).agg(F.count("*"), F.sum("x")).first()
    fts_index.build(a.limit(0), none, buckets=4)
    assert fts_index.search(spark, none, "cat", buckets=4).count() == 0


def test_equal_keys_are_hashed_once(spark):
    """Keys of a filter are made distinct, and dealt to all tasks, before they are hashed."""
    df = spark.range(10).select((F.col("id") % 3).cast("string").alias("k"))
    bits = hashes.bloom_filter(df, "k", lambda c: hashes.title_positions(c, 5))
    plan = bits._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("fnv1a_32") :]
    assert {r["bit"] for r in bits.collect()} == {(hashes.fnv1a(k, 32) + i * hashes.fnv1a(k + k, 32)) % 50 for k in (b"0", b"1", b"2") for i in range(7)}


def test_pairs_are_dealt_to_many_tasks(spark, monkeypatch):
    """Small tables with many pairs are not joined in the task or two that read them, a crowded cell is cut, and no pair is lost."""
    monkeypatch.setattr(geocells, "SLICE", 50)
    p = spark.range(1200).select("id", (F.col("id") % 30 / 100.0).alias("lat"), (F.col("id") % 7 / 100.0).alias("lng")).coalesce(1)
    met = geocells.radius_join(p.where("id % 20 = 0").withColumnRenamed("id", "centre"), p, 50_000.0, tasks=32)
    got = met.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(got) >= 10 and sum(r["count"] for r in got) == 60 * 1200 == met.select("centre", "id").distinct().count()
