"""Further named queries: classification, logs, embeddings, vector indexes, edges, exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.functions import classify, embedding, logs, vectors, wikidoc
from tessera.operators import clusters, graph, search, storage
from tessera.plans.catalog import ARTICLES, LOG, VEC, articles, embedded, log, query, t
from tessera.streaming.state import millis, rate_limited_fixed

BOXES = ["football player", "french city", "rock album", "korean film", "summer olympics", "dog breed", "fc company"]
BOX_SQL = f"{BOXES}[CAST(p_partkey % 8 + 1 AS INT)]"  # the eighth is null
KIND_SQL = "['person','place','work','work','event','other','org'][CAST(p_partkey % 8 + 1 AS INT)]"
CATEGORY_SQL = "CASE WHEN p_partkey % 3 = 0 THEN ['Living people', 'Cities in X'] WHEN p_partkey % 3 = 1 THEN ['Populated places'] ELSE [] END"


def boxed(spark, d):
    box = F.get(F.array(*map(F.lit, BOXES)), (F.col("p_partkey") % 8).cast("int"))
    cats = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Living people"), F.lit("Cities in X"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("Populated places"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "part").select("p_partkey", box.alias("box"), cats.alias("categories"), F.col("p_name").alias("text"))


@query(f"SELECT p_partkey, coalesce({KIND_SQL}, CASE p_partkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'other' END) AS type, CASE WHEN p_partkey % 8 < 7 THEN 'medium' ELSE 'low' END AS confidence FROM part")
def article_types(spark, d):
    return boxed(spark, d).select("p_partkey", classify.article_type(F.col("box"), F.col("categories"), F.col("text")).alias("type"), classify.confidence(F.col("box")).alias("confidence"))


@query(
    """WITH b AS (SELECT p_partkey, p_partkey % 8 AS i, p_partkey % 3 AS c FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN 160 ELSE 0 END + CASE c WHEN 0 THEN 30 ELSE 0 END AS person, CASE i WHEN 1 THEN 160 ELSE 0 END + CASE c WHEN 0 THEN 30 WHEN 1 THEN 30 ELSE 0 END AS place,
 CASE WHEN i IN (1, 6) THEN 80 ELSE 0 END AS org, CASE i WHEN 2 THEN 80 WHEN 3 THEN 160 ELSE 0 END AS work, CASE i WHEN 4 THEN 80 ELSE 0 END AS event, CASE WHEN i = 5 THEN 80 WHEN i = 7 AND c = 2 THEN 1 ELSE 0 END AS other FROM b"""
)
def type_scores(spark, d):
    return boxed(spark, d).select("p_partkey", classify.type_scores(F.col("box"), F.col("categories"), F.col("text")).alias("s")).select("p_partkey", "s.*")


PATHS = ["/", "/_health", "/fr/Paris", "/fr/Paris/links", "/Paris.json", "/Paris", "/Paris/summary", "/a/b/c"]


@query(f"SELECT event_id, ['/','/_health','/:lang/:title','/:lang/:title/:section','/:title.json','/:title','/:title/:section','/:title/*'][CAST(event_id % {len(PATHS)} + 1 AS INT)] AS route FROM events")
def request_routes(spark, d):
    path = F.get(F.array(*map(F.lit, PATHS)), (F.col("event_id") % len(PATHS)).cast("int"))
    return t(spark, d, "events").select("event_id", logs.endpoint(path).alias("route"))


@query(
    LOG
    + """, c AS (SELECT endpoint, count(*) FILTER (latency <= 5) a, count(*) FILTER (latency <= 25) b, count(*) FILTER (latency <= 100) c FROM log GROUP BY endpoint), x AS (SELECT *, c * 0.5 AS g FROM c)
SELECT endpoint, round(CASE WHEN a >= g THEN g / greatest(a, 1) * 5 WHEN b >= g THEN 5 + (g - a) / greatest(b - a, 1) * 20 ELSE 25 + (g - b) / greatest(c - b, 1) * 75 END, 6) AS median FROM x"""
)
def bucket_medians(spark, d):
    at_most = lambda n: F.struct(F.lit(float(n)).alias("le"), F.count_if(F.col("latency") <= n).alias("count"))
    b = log(spark, d).groupBy("endpoint").agg(F.array(at_most(5), at_most(25), at_most(100)).alias("b"))
    return b.select("endpoint", F.round(logs.bucket_percentile(F.col("b"), F.element_at("b", -1)["count"], 0.5), 6).alias("median"))


def traced(spark, d):
    """Events as log events of handlers."""
    e = t(spark, d, "events")
    bad = F.col("event_type") == "error"
    note = F.struct(F.lit(1).cast("long").alias("timestamp"), F.when(bad, "error").otherwise("info").alias("level"), F.col("event_type").alias("message"))
    failure = F.struct(F.lit("Error").alias("name"), F.col("event_type").alias("message"), F.lit(1).cast("long").alias("timestamp"))
    request = F.struct(F.concat(F.lit("https://x/"), "event_type").alias("url"), F.lit("GET").alias("method"), F.struct(F.lit("AMS").alias("colo"), F.lit("NL").alias("country")).alias("cf"))
    return e.select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "api").alias("scriptName"), F.when(F.col("event_id") % 7 == 0, "exceededCpu").otherwise("ok").alias("outcome"),
        millis(F.col("ts")).alias("eventTimestamp"), F.struct(request.alias("request")).alias("event"), F.array(note).alias("logs"),
        F.filter(F.array(failure), lambda _: bad).alias("exceptions"), F.array(F.struct(F.col("value").alias("cpuTime"))).alias("diagnosticsChannelEvents"),
    )


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_type = 'error'")
def log_filter(spark, d):
    return traced(spark, d).where(logs.event_filter(script_names=["api"], log_levels=["error"], url_patterns=["*/err?r"])).select("event_id")


@query("SELECT count(*) AS events, count(*) FILTER (event_id % 7 = 0) AS \"exceededCpu\", 0 AS \"exceededMemory\", count(*) FILTER (event_type = 'error') AS exceptions FROM events WHERE event_id % 7 = 0 OR event_type = 'error'")
def log_alerts(spark, d):
    return logs.alert_summary(logs.processed(traced(spark, d)))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'unknown' END AS script, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS exceptions FROM events GROUP BY 1")
def log_points(spark, d):
    p = logs.data_points(logs.processed(traced(spark, d)))
    return p.groupBy(F.col("blobs")[0].alias("script")).agg(F.sum(F.col("doubles")[0]).cast("long").alias("n"), F.sum(F.col("doubles")[2]).alias("exceptions"))


@query("SELECT vec_id, list_transform(e, lambda x: CAST(floor((x - list_min(e)) / (CASE WHEN list_max(e) = list_min(e) THEN 1.0 ELSE list_max(e) - list_min(e) END) * 255 + 0.5) AS INT)) AS q FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def min_max_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vectors.min_max_quantised(F.col("embedding")).alias("q"))


@query(VEC + "SELECT id, round(list_sum(list_transform(list_zip(e,q), lambda p: (p[1]-p[2])*(p[1]-p[2]))), 6) AS distance FROM v, q ORDER BY list_sum(list_transform(list_zip(e,q), lambda p: (p[1]-p[2])*(p[1]-p[2]))), id LIMIT 10")
def ivf_all_cells(spark, d):
    """All cells are probed, so that the result is the exact one."""
    v, q = embedded(spark, d)
    centres = clusters.kmeans(v, 8)
    return clusters.ivf_search(clusters.with_cells(v, centres), centres, q, 10, nprobe=8).select("id", F.round("distance", 6).alias("distance"))


@query()
def ivf_nearest(spark, d):
    v, q = embedded(spark, d)
    centres = clusters.kmeans(v, 16)
    return clusters.ivf_search(clusters.with_cells(v, centres), centres, q, 10)


@query()
def pq_nearest(spark, d):
    v, q = embedded(spark, d)
    codes = clusters.ProductCodes(v, parts=16, words=32)
    return codes.search(v.withColumn("codes", codes.codes(F.col("embedding"))), q, 10)


@query()
def pca_vectors(spark, d):
    v, _ = embedded(spark, d)
    return v.select("id", clusters.projected(F.col("embedding"), clusters.principal_components(v, 8)).alias("p"))


TERMS = "SELECT p_partkey AS id, p_name AS term, CASE WHEN p_partkey % 4 = 0 THEN 'title' WHEN p_partkey % 4 = 1 THEN 'entity' WHEN p_partkey % 4 = 2 THEN 'category' ELSE 'query' END AS source FROM part"


def terms(spark, d):
    i = F.col("p_partkey") % 4
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.col("p_name").alias("normalized"), F.when(i == 0, "title").when(i == 1, "entity").when(i == 2, "category").otherwise("query").alias("source"))


@query(f"SELECT term AS normalized, term, source, id FROM ({TERMS}) QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE source WHEN 'title' THEN 1 WHEN 'entity' THEN 2 WHEN 'category' THEN 3 ELSE 4 END, id) = 1")
def lookup_terms(spark, d):
    return embedding.unique_terms(terms(spark, d))


@query("SELECT count(*) AS lookups, count(*) FILTER (p_name IN (SELECT p_name FROM part WHERE p_partkey % 10 = 0)) AS hits, count(*) FILTER (p_name IN (SELECT p_name FROM part WHERE p_partkey % 10 = 0)) / count(*) AS hit_rate FROM part")
def lookup_hits(spark, d):
    known = embedding.with_embeddings(terms(spark, d).where("id % 10 = 0").select("normalized").distinct(), "normalized", embedding.hashing_embedder(16))
    return embedding.hit_stats(embedding.looked_up(terms(spark, d), known))


@query(ARTICLES + "SELECT id, type, true AS unit FROM articles WHERE regexp_matches(title, '[A-Za-z0-9]')")
def embedded_articles(spark, d):
    a = articles(spark, d).where("title rlike '[A-Za-z0-9]'").withColumn("full", embedding.embedding_text(F.col("title"), F.col("content")))
    e = embedding.with_embeddings(a.select("id", "type", "full"), "full", embedding.hashing_embedder(64))
    return e.select("id", "type", (F.abs(vectors.norm(F.col("embedding")) - 1) < 1e-3).alias("unit"))


def linked(spark, d):
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    n = t(spark, d, "nation").join(F.broadcast(r), "n_regionkey")
    box = F.create_map(F.lit("location"), F.col("r_name"), F.lit("author"), F.concat(F.lit("[["), "n_name", F.lit("]]")))
    return n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("[["), "r_name", F.lit("|x]] [[File:a.png]] [["), "r_name", F.lit("]]")).alias("content"), box.alias("infobox"), F.col("n_name").alias("title"))


@query("SELECT n_nationkey AS from_id, 'links_to' AS predicate, r_name AS to_title FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'created_by', replace(n_name, '_', ' ') FROM nation")
def article_edges(spark, d):
    return graph.extracted_edges(linked(spark, d))


@query("SELECT n_nationkey AS article_id, 'unknown' AS infobox_type, r_name AS country, CAST(1000 + n_nationkey AS BIGINT) AS population FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def export_infoboxes(spark, d):
    box = F.create_map(F.lit("country"), F.element_at("infobox", "location"), F.lit("population"), F.concat(F.regexp_replace((F.col("id") + 1000).cast("string"), r"^(\d)", "$1,"), F.lit(" people")))
    a = linked(spark, d).select("id", "title", F.when(F.col("id") % 2 == 0, box).alias("infobox"))
    return storage.infobox_export(a).select("article_id", "infobox_type", "country", "population")


@query(ARTICLES + "SELECT id, 2 * length(id) + 2 * length(title) + 2 * length(type) + 40 + 2 * length(content) + 38 + 4 * 1024 AS bytes FROM articles")
def row_sizes(spark, d):
    a = articles(spark, d)
    return a.select("id", storage.row_size(a, dimensions=1024).alias("bytes"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS src FROM orders")
def merged_indexes(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return storage.merged_index([o.withColumn("src", F.lit("a")), o.where("id % 3 = 0").withColumn("src", F.lit("b"))], "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'inline' ELSE 'full' END AS src FROM orders")
def merged_results(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return search.first_source_wins([o.where("id % 3 = 0").withColumn("src", F.lit("inline")), o.withColumn("src", F.lit("full"))], "id")


@query("SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_brand || ' ' || p_name, ' ')))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_brand || ' ' || p_name, ' ')))), 6) AS jaccard FROM part")
def word_overlap(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(search.word_jaccard(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")), 6).alias("jaccard"))


@query()
def fixed_window_admission(spark, d):
    e = t(spark, d, "events").select("user_id", millis(F.col("ts")).alias("ms"), "event_id")
    return rate_limited_fixed(e, "user_id", "ms", "event_id", limit=3, window_ms=86_400_000)


@query("SELECT n_nationkey AS id, n_name AS title, n_name || ' is in ' || r_name || '.' AS summary, r_name AS region, '# ' || replace(n_name, '_', ' ') AS heading, 'Kind' AS kind, 1 AS refs FROM nation JOIN region ON n_regionkey = r_regionkey")
def wiki_documents(spark, d):
    a = linked(spark, d)
    region = F.element_at("infobox", "location")
    w = F.concat(F.lit("'''"), "title", F.lit("''' is in [["), region, F.lit("|"), region, F.lit("]].<ref name=a>{{cite web|title=x}}</ref>\n== Facts ==\n{|\n! Kind !! Region\n|-\n| Kind || "), region, F.lit("\n|}\n"))
    doc = a.select("id", "title", wikidoc.document("title", w, date(2024, 1, 1)).alias("d"))
    row = F.col("d.tables")[0][0]
    return doc.select("id", "title", F.col("d.summary").alias("summary"), row["Region"].alias("region"), F.substring_index("d.markdown", "\n", 1).alias("heading"), row["Kind"].alias("kind"), F.size("d.references").alias("refs"))
