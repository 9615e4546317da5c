"""Named queries over the driver tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import geo, text, vectors, wikitext
from tessera.functions.filters import run_query
from tessera.functions.hashes import djb2_32
from tessera.operators import graph, search, storage
from tessera.operators.knn import nearest, nearest_by_partition
from tessera.streaming.state import breaker_states, millis, rate_limited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as typed articles: first line, first paragraph, six types in turn."""
    doc, body = t(spark, d, "documents"), F.col("text")
    kind = F.element_at(F.array(*map(F.lit, storage.TYPES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return doc.select(F.col("doc_id").cast("string").alias("id"), kind.alias("type"), F.substring_index(body, "\n", 1).alias("title"), F.substring(F.substring_index(body, "\n\n", 1), 1, 500).alias("description"), body.alias("content"), "lang", "source", "n_chars")


ARTICLES = """WITH articles AS (SELECT CAST(doc_id AS VARCHAR) AS id, ['person','place','org','work','event','other'][CAST(doc_id % 6 + 1 AS INT)] AS type,
 split_part(text, chr(10), 1) AS title, substr(split_part(text, chr(10) || chr(10), 1), 1, 500) AS description, text AS content, lang, source, n_chars FROM documents) """


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers with coordinates made from their keys."""
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k.alias("id"), "c_mktsegment", ((k * 7919) % 17000 / 100.0 - 85).alias("lat"), ((k * 104729) % 36000 / 100.0 - 180).alias("lng"))


PLACES = "WITH places AS (SELECT c_custkey AS id, c_mktsegment, (c_custkey*7919)%17000/100.0-85 AS lat, (c_custkey*104729)%36000/100.0-180 AS lng FROM customer) "
NEAR = "2*6371008.8*atan2(sqrt(a),sqrt(1-a))"


# --- scans, storage, projections -------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND n_chars > 1000")
def scan_projection(spark, d):
    return t(spark, d, "documents").where("lang = 'fr' and n_chars > 1000").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def scan_page(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(50).limit(25)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id = 7")
def point_read(spark, d):
    return t(spark, d, "documents").where("doc_id = 7").select("doc_id", "n_chars")


@query(ARTICLES + "SELECT id, type, title, description FROM articles")
def articles_from_documents(spark, d):
    return articles(spark, d).select("id", "type", "title", "description")


@query(PLACES + "SELECT id, CASE WHEN id % 10 <> 0 THEN lat END AS lat, CASE WHEN id % 10 <> 0 THEN lng END AS lng, id % 10 <> 0 AS has_coords FROM places")
def api_projection(spark, d):
    p = places(spark, d).withColumn("lat", F.when(F.col("id") % 10 != 0, F.col("lat")))
    p = p.withColumn("coords", F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng")))
    return p.select("id", "coords.lat", "coords.lng", F.col("coords").isNotNull().alias("has_coords"))


@query(ARTICLES + "SELECT id, title, CASE WHEN length(description) <= 200 THEN description WHEN position(' ' IN substr(description,1,200)) > 0 AND 200 - position(' ' IN reverse(substr(description,1,200))) > 100 THEN substr(description, 1, 200 - position(' ' IN reverse(substr(description,1,200)))) || '...' ELSE substr(description,1,200) || '...' END AS description FROM articles")
def export_index(spark, d):
    return articles(spark, d).select("id", "title", text.shortened(F.col("description")).alias("description"))


@query(ARTICLES + "SELECT coalesce(try_cast(id AS BIGINT), 0) AS pageid, id, type, title, length(content) AS content_length FROM articles")
def export_full(spark, d):
    return articles(spark, d).select(F.coalesce(F.expr("try_cast(id as bigint)"), F.lit(0)).alias("pageid"), "id", "type", "title", F.length("content").cast("long").alias("content_length"))


@query(ARTICLES + "SELECT id, coalesce(nullif(title,''), nullif(description,''), id) AS label, CASE WHEN type='person' THEN lang WHEN type='place' THEN source END AS extra FROM articles")
def export_by_type(spark, d):
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return articles(spark, d).select("id", F.coalesce(empty("title"), empty("description"), F.col("id")).alias("label"), F.when(F.col("type") == "person", F.col("lang")).when(F.col("type") == "place", F.col("source")).alias("extra"))


@query(ARTICLES + "SELECT id, len(list_filter(['id','title','content'], lambda c: CASE c WHEN 'id' THEN id = '' WHEN 'title' THEN title = '' ELSE length(content) < 200 END)) AS errors FROM articles")
def dataset_validation(spark, d):
    bad = F.array_compact(F.array(F.when(F.col("id") == "", F.lit("id")), F.when(F.col("title") == "", F.lit("title")), F.when(F.length("content") < 200, F.lit("content"))))
    return articles(spark, d).select("id", F.size(bad).cast("long").alias("errors"))


@query(ARTICLES + ", c AS (SELECT type, count(*) AS n FROM articles GROUP BY type) SELECT type, n, round(100.0*n/sum(n) OVER (), 4) AS percent, CASE WHEN sum(n) OVER () < 1000 THEN 'n<1K' WHEN sum(n) OVER () < 10000 THEN '1K<n<10K' ELSE '10K<n<100K' END AS bucket FROM c")
def dataset_card(spark, d):
    n, all_ = F.col("n"), F.sum("n").over(Window.partitionBy())
    c = articles(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    bucket = F.when(all_ < 1000, "n<1K").when(all_ < 10000, "1K<n<10K").when(all_ < 100_000, "10K<n<100K").when(all_ < 1_000_000, "100K<n<1M").when(all_ < 10_000_000, "1M<n<10M").otherwise("n>10M")
    return c.select("type", "n", F.round(100.0 * n / all_, 4).alias("percent"), bucket.alias("bucket"))


@query(ARTICLES + "SELECT type, count(*) AS rows, sum(n_chars) AS chars FROM articles GROUP BY type")
def manifest_counts(spark, d):
    return articles(spark, d).groupBy("type").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 5 = 0")
def upsert_rows(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return storage.upserted(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_field(spark, d):
    return t(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


# --- the query language -------------------------------------------------------------------------------------

FILTERS = {
    "filter_eq": ([{"field": "lang", "operator": "eq", "value": "de"}], "lang = 'de'"),
    "filter_ne": ([{"field": "lang", "operator": "ne", "value": "en"}], "lang IS DISTINCT FROM 'en'"),
    "filter_gt": ([{"field": "n_chars", "operator": "gt", "value": 4000}], "n_chars > 4000"),
    "filter_gte": ([{"field": "n_chars", "operator": "gte", "value": 4000}], "n_chars >= 4000"),
    "filter_lt": ([{"field": "n_chars", "operator": "lt", "value": 300}], "n_chars < 300"),
    "filter_lte": ([{"field": "n_chars", "operator": "lte", "value": 300}], "n_chars <= 300"),
    "filter_in": ([{"field": "source", "operator": "in", "value": ["src1", "src2"]}], "source IN ('src1','src2')"),
    "filter_contains": ([{"field": "title", "operator": "contains", "value": "THE"}], "contains(lower(title),'the')"),
    "filter_starts_with": ([{"field": "title", "operator": "starts_with", "value": "th"}], "starts_with(lower(title),'th')"),
    "filter_conjunction": ([{"field": "lang", "operator": "eq", "value": "en"}, {"field": "n_chars", "operator": "lt", "value": 900}], "lang = 'en' AND n_chars < 900"),
    "filter_wrong_type": ([{"field": "lang", "operator": "gt", "value": 5}], "false"),
}


def _filtered(filters: list[dict]) -> Callable:
    return lambda spark, d: run_query(articles(spark, d), filters, limit=100, order_by="n_chars", order_dir="desc").select("id", "lang", "n_chars")


for _name, (_filters, _where) in FILTERS.items():
    QUERIES[_name] = _filtered(_filters)
    SQL[_name] = ARTICLES + f"SELECT id, lang, n_chars FROM articles WHERE {_where} ORDER BY n_chars DESC NULLS LAST, id LIMIT 100"


@query(ARTICLES + "SELECT id, type, title FROM articles WHERE type = 'work' ORDER BY title NULLS LAST, id LIMIT 20 OFFSET 5")
def query_by_type(spark, d):
    return run_query(articles(spark, d), type="work", order_by="title", limit=20, offset=5).select("id", "type", "title")


@query(ARTICLES + "SELECT id, title FROM articles WHERE contains(lower(title),'er') OR contains(lower(description),'er')")
def text_substring_search(spark, d):
    has = lambda c: F.contains(F.lower(c), F.lit("er"))
    return articles(spark, d).where(has("title") | has("description")).select("id", "title")


# --- joins and the graph ------------------------------------------------------------------------------------

HREFS = "WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) "


def hrefs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query(HREFS + "SELECT page_id, href, count(*) AS n FROM links GROUP BY page_id, href")
def links_extracted(spark, d):
    return hrefs(spark, d).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(HREFS + ", named AS (SELECT regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href, min(page_id) AS to_id FROM pages GROUP BY 1) SELECT page_id AS from_id, to_id FROM (SELECT DISTINCT * FROM links) JOIN named USING (href)")
def links_resolved(spark, d):
    """A page is known by its first link's path; unknown targets are dropped."""
    named = t(spark, d, "pages").groupBy(F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("href")).agg(F.min("page_id").alias("to_id"))
    return hrefs(spark, d).distinct().join(named, "href").select(F.col("page_id").alias("from_id"), "to_id")


@query(HREFS + "SELECT l.page_id AS from_id, coalesce(CAST(p.page_id AS VARCHAR), '') AS to_id, href FROM (SELECT DISTINCT * FROM links) l LEFT JOIN pages p ON l.href = p.url")
def links_outgoing(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("to"), F.col("url").alias("href"))
    return hrefs(spark, d).distinct().join(p, "href", "left").select(F.col("page_id").alias("from_id"), F.coalesce(F.col("to").cast("string"), F.lit("")).alias("to_id"), "href")


@query(HREFS + "SELECT href, count(DISTINCT page_id) AS backlinks FROM links GROUP BY href")
def backlinks(spark, d):
    return hrefs(spark, d).groupBy("href").agg(F.countDistinct("page_id").alias("backlinks"))


NATIONS = "WITH titles AS (SELECT n_nationkey AS id, n_name AS title FROM nation), links AS (SELECT s_suppkey AS from_id, 'located_in' AS predicate, lower(replace(n_name,'_',' ')) AS to_title FROM supplier JOIN nation ON s_nationkey = n_nationkey) "


def supplier_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = t(spark, d, "nation")
    titles = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    links = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("from_id"), F.lit("located_in").alias("predicate"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("to_title"))
    return links, titles


@query(NATIONS + "SELECT from_id, predicate, id AS to_id, to_title FROM links JOIN titles ON lower(replace(title,'_',' ')) = to_title")
def edges_forward(spark, d):
    return graph.forward_edges(*supplier_links(spark, d))


@query(NATIONS + "SELECT id AS to_id, 'contains' AS reverse_predicate, from_id, 'S' || from_id AS from_title FROM links JOIN titles ON lower(replace(title,'_',' ')) = to_title")
def edges_reverse(spark, d):
    named = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("title"))
    return graph.reverse_edges(graph.forward_edges(*supplier_links(spark, d)), named)


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def batch_lookup(spark, d):
    n = t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def lookup_misses(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id > 500")
def resume_after(spark, d):
    return t(spark, d, "documents").where("doc_id > 500").select("doc_id")


# --- aggregates, windows, operations ------------------------------------------------------------------------

LOG = "WITH log AS (SELECT event_id, ts, user_id, event_type AS endpoint, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status, value AS latency, event_id % 3 = 0 AS hit FROM events) "


def log(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency"), (F.col("event_id") % 3 == 0).alias("hit"))


@query(ARTICLES + "SELECT k.type, count(a.id) AS n FROM (SELECT unnest(['person','place','org','work','event','other']) AS type) k LEFT JOIN (SELECT * FROM articles WHERE lang = 'xx' OR n_chars > 20000) a USING (type) GROUP BY k.type")
def count_by_type(spark, d):
    kinds = spark.createDataFrame([(x,) for x in storage.TYPES], "type string")
    n = articles(spark, d).where("lang = 'xx' or n_chars > 20000").groupBy("type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "type", "left").fillna(0, ["n"])


@query(LOG + "SELECT endpoint, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, count(*) FILTER (hit) AS hits, round(avg(latency), 4) AS mean, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99 FROM log GROUP BY endpoint")
def request_rollup(spark, d):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency)")
    return log(spark, d).groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.count_if("hit").alias("hits"), F.round(F.avg("latency"), 4).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(LOG + "SELECT count(*) AS requests, floor(count(*) FILTER (status >= 400) / count(*) * 10000 + 0.5) / 100 AS error_rate, floor(count(*) FILTER (hit) / count(*) * 10000 + 0.5) / 100 AS hit_rate FROM log")
def derived_rates(spark, d):
    rate = lambda c: (F.floor(F.count_if(c) / F.count("*") * 10000 + 0.5) / 100)
    return log(spark, d).agg(F.count("*").alias("requests"), rate(F.col("status") >= 400).alias("error_rate"), rate(F.col("hit")).alias("hit_rate"))


@query(LOG + "SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS requests, count(DISTINCT user_id) AS users FROM log GROUP BY 1")
def hourly_snapshot(spark, d):
    return log(spark, d).groupBy(F.replace(F.substring(F.col("ts").cast("string"), 1, 13), F.lit(" "), F.lit("T")).alias("hour")).agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("users"))


BOUNDS = (5, 10, 25, 50, 100)


@query(LOG + "SELECT endpoint, le, count(*) FILTER (latency <= le) AS n FROM log, (SELECT unnest([5,10,25,50,100]) AS le) GROUP BY endpoint, le")
def histogram_buckets(spark, d):
    n = [F.struct(F.lit(b).alias("le"), F.count_if(F.col("latency") <= b).alias("n")) for b in BOUNDS]
    return log(spark, d).groupBy("endpoint").agg(F.array(*n).alias("b")).select("endpoint", F.inline("b"))


@query(LOG + "SELECT endpoint, status, count(*) AS n, max_by(latency, event_id) AS last FROM log GROUP BY endpoint, status")
def counters_and_gauges(spark, d):
    return log(spark, d).groupBy("endpoint", "status").agg(F.count("*").alias("n"), F.max_by("latency", "event_id").alias("last"))


@query(LOG + "SELECT endpoint, event_id, latency FROM log QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) <= 10")
def last_latencies(spark, d):
    w = Window.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id"))
    return log(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("endpoint", "event_id", "latency")


@query(LOG + "SELECT event_id, ts FROM log WHERE status >= 400 ORDER BY ts DESC, event_id DESC LIMIT 100")
def error_ring(spark, d):
    return log(spark, d).where("status >= 400").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS arrivals FROM events")
def sliding_arrivals(spark, d):
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-86399999, 0)
    return t(spark, d, "events").withColumn("ms", millis(F.col("ts"))).select("event_id", F.count("*").over(w).alias("arrivals"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_write_wins(spark, d):
    return storage.last_of_each(t(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS qty, round(sum(l_extendedprice*(1-l_discount)),2) AS net, count(*) AS n FROM lineitem GROUP BY 1, 2")
def rollup_lineitem(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.count("*").alias("n"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.countDistinct("o_orderkey").alias("orders"))
    return o.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "orders")


@query("SELECT CAST(sum(ceil(length(text)/4.0)) AS BIGINT) AS tokens, count(*) AS n FROM documents")
def token_cost(spark, d):
    return t(spark, d, "documents").agg(F.sum(F.ceil(F.length("text") / 4.0)).cast("long").alias("tokens"), F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN value <= 30 THEN 'fresh' WHEN value <= 60 THEN 'stale' ELSE 'expired' END AS state, count(*) AS n FROM events GROUP BY 1, 2")
def cache_state(spark, d):
    state = F.when(F.col("value") <= 30, "fresh").when(F.col("value") <= 60, "stale").otherwise("expired")
    return t(spark, d, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) SELECT user_id, min(ts) AS begin, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(spark, d):
    return t(spark, d, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begin"), "n")


@query()
def rate_limit_admission(spark, d):
    e = t(spark, d, "events").withColumn("ms", millis(F.col("ts")))
    return rate_limited(e, "user_id", "ms", "event_id", limit=2, window_ms=86_400_000)


@query()
def circuit_breaker(spark, d):
    e = t(spark, d, "events").withColumn("ms", millis(F.col("ts"))).withColumn("ok", F.col("event_type") != "error")
    return breaker_states(e, "user_id", "ms", "ok", "event_id")


# --- strings --------------------------------------------------------------------------------------------------


@query(r"SELECT n_nationkey, trim(regexp_replace(replace(lower(n_name),'_',' '), '\s+', ' ', 'g')) AS key, regexp_replace(regexp_replace(trim(lower(n_name)), '\s+', '_', 'g'), '_+', '_', 'g') AS under, trim(regexp_replace(replace(lower(n_name),'_',' '), '[^A-Za-z0-9_\s]', '', 'g')) AS search FROM nation")
def title_keys(spark, d):
    n = F.col("n_name")
    return t(spark, d, "nation").select("n_nationkey", text.title_key(n).alias("key"), text.underscore_key(n).alias("under"), text.search_key(n).alias("search"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def term_similarity(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return t(spark, d, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(text.similarity(a, b), 6).alias("similarity"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 's') ORDER BY p_name, p_partkey LIMIT 10")
def autocomplete(spark, d):
    return t(spark, d, "part").where(F.startswith(text.title_key(F.col("p_name")), F.lit("s"))).orderBy("p_name", "p_partkey").limit(10).select("p_partkey", "p_name")


@query()
def title_scores(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(text.title_score(F.col("p_name"), "red tin"), 6).alias("score"))


@query()
def fuzzy_terms(spark, d):
    names = t(spark, d, "part").select("p_name").distinct()
    a, b = names.toDF("a"), names.toDF("b")
    near = a.join(b, (F.substring("a", 1, 3) == F.substring("b", 1, 3)) & (F.col("a") < F.col("b")))
    return near.withColumn("score", text.jaro_winkler("a", "b")).where("score >= 0.8").withColumn("score", F.round("score", 6))


@query()
def normalised_terms(spark, d):
    return articles(spark, d).select("id", text.normalise_term("title").alias("term"))


@query()
def term_hashes(spark, d):
    return t(spark, d, "part").select("p_partkey", djb2_32("p_name").alias("djb2"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def stripped_pages(spark, d):
    c = F.regexp_replace("html", "<[^>]*>", "")
    return t(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(c, r"\s+", " ")).alias("plain"))


# --- full-text search -----------------------------------------------------------------------------------------

STOP = "[" + ",".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
FTS = ARTICLES + f""", words AS (
 SELECT id, w, unnest(list_filter(list_transform(regexp_extract_all(c, '{text.TOKEN}'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 50 AND NOT list_contains({STOP}, x))) AS term
 FROM (SELECT id, title AS c, 2.0 AS w FROM articles UNION ALL SELECT id, description, 1.5 FROM articles UNION ALL SELECT id, content, 1.0 FROM articles)),
 sizes AS (SELECT id, sum(w) AS dl FROM words GROUP BY id), corpus AS (SELECT (SELECT count(*) FROM articles) AS n, (SELECT sum(dl) FROM sizes) AS total) """


@query(FTS + "SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM words GROUP BY term")
def fts_vocabulary(spark, d):
    return search.vocabulary(articles(spark, d))


@query(FTS + """, hits AS (SELECT id, term, count(*) AS tf, max(w) AS w FROM words WHERE term IN ('thing','ention','ered') GROUP BY id, term),
 df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
 SELECT id, round(sum(greatest(0, ln((n-df+0.5)/(df+0.5)+1)) * tf*2.2/(tf+1.2*(0.25+0.75*dl/(total/n))) * w), 6) AS score FROM hits JOIN df USING (term) JOIN sizes USING (id), corpus GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def fts_bm25(spark, d):
    return search.bm25(articles(spark, d), "Thing ention ered", 20, stem=False).select("id", F.round("score", 6).alias("score"))


@query()
def fts_stemmed(spark, d):
    return search.bm25(articles(spark, d), "things entions ered", 20)


@query(FTS + "SELECT count(DISTINCT term) AS vocabulary, count(DISTINCT id) AS docs, CAST(max(n) AS BIGINT) AS all_docs, round(max(total/n), 4) AS mean_length FROM words, corpus")
def fts_stats(spark, d):
    a = articles(spark, d)
    sums = search.corpus_stats(a).select(F.col("with_terms").alias("docs"), F.col("n").alias("all_docs"), F.round(F.col("total") / F.col("n"), 4).alias("mean_length"))
    return search.vocabulary(a).agg(F.count("*").alias("vocabulary")).join(F.broadcast(sums), F.lit(True))  # one row each


# --- vectors ----------------------------------------------------------------------------------------------------

VEC = "WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 3) "


def embedded(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return v, v.where("id = 3").first()["embedding"]


@query(VEC + "SELECT id, round(1 - list_dot_product(e, q) / sqrt(list_dot_product(e,e) * list_dot_product(q,q)), 6) AS distance FROM v, q ORDER BY 1 - list_dot_product(e, q) / sqrt(list_dot_product(e,e) * list_dot_product(q,q)), id LIMIT 10")
def knn_cosine(spark, d):
    v, q = embedded(spark, d)
    return nearest(v, q, 10).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(VEC + "SELECT id, round(1/(1+list_sum(list_transform(list_zip(e,q), lambda p: (p[1]-p[2])*(p[1]-p[2])))), 6) AS score FROM v, q ORDER BY list_sum(list_transform(list_zip(e,q), lambda p: (p[1]-p[2])*(p[1]-p[2]))), id LIMIT 10")
def knn_l2(spark, d):
    v, q = embedded(spark, d)
    return nearest(v, q, 10, "l2").select("id", F.round("score", 6).alias("score"))


@query(VEC + "SELECT id, round(list_dot_product(e, q), 6) AS score FROM v, q WHERE label IN (1,2,3) ORDER BY list_dot_product(e, q) DESC, id LIMIT 10")
def knn_filtered(spark, d):
    v, q = embedded(spark, d)
    return nearest(v.where("label in (1,2,3)"), q, 10, "dot").select("id", F.round("score", 6).alias("score"))


@query(VEC + ", n AS (SELECT id, label, 1 - list_dot_product(e, q) / sqrt(list_dot_product(e,e) * list_dot_product(q,q)) AS d FROM v, q) SELECT id, label FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= 10) ORDER BY d, id LIMIT 5")
def knn_partitions(spark, d):
    v, q = embedded(spark, d)
    return nearest_by_partition(v, q, 5, "label").select("id", "label")


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor((greatest(-1.0, least(1.0, x)) + 1) * 127.5 + 0.5) AS INT)) AS q FROM embeddings")
def quantised_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vectors.quantised(F.col("embedding")).alias("q"))


@query(VEC + ", a AS (SELECT id, row_number() OVER (ORDER BY list_dot_product(e,q) DESC, id) - 1 AS r FROM v, q QUALIFY r < 20), b AS (SELECT id, row_number() OVER (ORDER BY label, id) - 1 AS r FROM v QUALIFY r < 20) SELECT id, round(sum(p), 8) AS score FROM (SELECT id, 0.5/(61+r) AS p FROM a UNION ALL SELECT id, 0.5/(61+r) FROM b) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10")
def hybrid_rrf(spark, d):
    v, q = embedded(spark, d)
    a = search.ranked(nearest(v, q, 20, "dot"), F.desc("score"))
    b = search.ranked(v.orderBy("label", "id").limit(20), F.col("label"))
    return search.fused({"vector": (a, 0.5), "text": (b, 0.5)}, 10).select("id", F.round("score", 8).alias("score"))


# --- places -----------------------------------------------------------------------------------------------------


@query()
def geohashes(spark, d):
    p = places(spark, d)
    return p.select("id", geo.geohash(F.col("lat"), F.col("lng"), 6).alias("geohash"))


@query(PLACES + f", n AS (SELECT id, {NEAR} AS m FROM (SELECT id, pow(sin(radians(lat-37.7749)/2),2)+cos(radians(37.7749))*cos(radians(lat))*pow(sin(radians(lng+122.4194)/2),2) AS a FROM places)) SELECT id, round(m, 2) AS metres FROM n WHERE m <= 2000000 ORDER BY m, id LIMIT 100")
def geo_radius(spark, d):
    m = geo.haversine(F.lit(37.7749), F.lit(-122.4194), F.col("lat"), F.col("lng"))
    return places(spark, d).withColumn("m", m).where("m <= 2000000").orderBy("m", "id").limit(100).select("id", F.round("m", 2).alias("metres"))


@query(PLACES + "SELECT id FROM places WHERE lat BETWEEN -20 AND 40 AND (lng >= 170 OR lng <= -170)")
def geo_box(spark, d):
    return places(spark, d).where(geo.in_box(F.col("lat"), F.col("lng"), -20, 170, 40, -170)).select("id")


# --- wikitext ---------------------------------------------------------------------------------------------------

WIKI = "WITH wiki AS (SELECT n_nationkey AS id, '{{Infobox country' || chr(10) || '| name = ' || n_name || chr(10) || '}}' || chr(10) || '''''''' || n_name || ''''''' in [[' || r_name || '|' || n_nationkey || ']]. [[Category:' || r_name || '|x]]' AS w, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) "


def wiki(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    n = t(spark, d, "nation").join(F.broadcast(r), "n_regionkey")
    w = F.concat(F.lit("{{Infobox country\n| name = "), "n_name", F.lit("\n}}\n'''"), "n_name", F.lit("''' in [["), "r_name", F.lit("|"), "n_nationkey", F.lit("]]. [[Category:"), "r_name", F.lit("|x]]"))
    return n.select(F.col("n_nationkey").alias("id"), w.alias("w"))


@query("SELECT n_nationkey AS id, r_name AS page, CAST(n_nationkey AS VARCHAR) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def wiki_links(spark, d):
    return wiki(spark, d).select("id", F.inline(wikitext.links(F.col("w"))))


@query("SELECT n_nationkey AS id, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey")
def wiki_categories(spark, d):
    return wiki(spark, d).select("id", F.explode(wikitext.categories(F.col("w"))).alias("category"))


@query("SELECT n_nationkey AS id, 'country' AS kind, n_name AS name, n_name AS title FROM nation")
def wiki_infobox(spark, d):
    p = wiki(spark, d).select("id", wikitext.parse("w").alias("p"), wikitext.bare_title(F.col("w")).alias("title"))
    return p.select("id", F.col("p.infobox_type").alias("kind"), F.col("p.infobox")["name"].alias("name"), "title")
