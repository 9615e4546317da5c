"""Queries over cells of the globe, stored indexes, pages of results, terms and vectors that change."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Window, functions as F

from tessera.functions import geo, geocells, hashes, text, vectors, wikidoc
from tessera.operators import fts_index, indexes, knn, search, storage
from tessera.plans import catalog
from tessera.plans.catalog import ARTICLES, FTS, LOG, PLACES, QUERIES, SQL, VEC, articles, embedded, log, places, query, t

BEFORE = set(QUERIES)


# --- cells of the globe ----------------------------------------------------------------------------------------


def code_sql(x: str, y: str, precision: int) -> str:
    """A geohash from cell numbers, in SQL."""
    bits_x, bits_y = geocells.sides(precision)
    letters = []
    for i in range(precision):
        bits = [f"(({x if k % 2 == 0 else y} >> {(bits_x if k % 2 == 0 else bits_y) - 1 - k // 2}) & 1) * {16 >> (k % 5)}" for k in range(5 * i, 5 * i + 5)]
        letters.append(f"substr('{geo.BASE32}', CAST({' + '.join(bits)} + 1 AS INT), 1)")
    return " || ".join(letters)


def cells_sql(precision: int) -> str:
    n_x, n_y = (1 << b for b in geocells.sides(precision))
    return PLACES + f", c AS (SELECT *, CAST(floor((lng+180)/360*{n_x}) AS BIGINT) AS x, CAST(floor((lat+90)/180*{n_y}) AS BIGINT) AS y FROM places) "


SQL["geohashes"] = cells_sql(6) + f"SELECT id, {code_sql('x', 'y', 6)} AS geohash FROM c"


@query(cells_sql(5) + f"SELECT id, {code_sql('x', 'y', 5)} AS geohash, round(y*180/4096.0-90, 6) AS south, round(x*360/8192.0-180, 6) AS west, round((y+1)*180/4096.0-90, 6) AS north, round((x+1)*360/8192.0-180, 6) AS east FROM c")
def geo_bounds(spark, d):
    p = places(spark, d).select("id", geo.geohash(F.col("lat"), F.col("lng"), 5).alias("geohash"))
    b = p.withColumn("b", geocells.bounds(F.col("geohash"), 5))
    return b.select("id", "geohash", *[F.round(f"b.{c}", 6).alias(c) for c in ("south", "west", "north", "east")])


AROUND_SQL = ", ".join(f"CASE WHEN x+{dx} BETWEEN 0 AND 31 AND y+{dy} BETWEEN 0 AND 31 THEN {code_sql(f'(x+{dx})', f'(y+{dy})', 2)} ELSE '' END AS {n}" for n, (dx, dy) in geocells.AROUND.items())


@query(cells_sql(2) + f"SELECT id, {AROUND_SQL} FROM c")
def geo_neighbours(spark, d):
    p = places(spark, d).select("id", geo.geohash(F.col("lat"), F.col("lng"), 2).alias("code"))
    return p.select("id", geocells.neighbours(F.col("code"), 2).alias("n")).select("id", "n.*")


@query(
    cells_sql(3)
    + f""", chosen AS (SELECT * FROM c WHERE id % 50 = 0), grid AS (SELECT gx, gy, gx*360/256.0-180 AS w, (gx+1)*360/256.0-180 AS e, gy*180/128.0-90 AS s, (gy+1)*180/128.0-90 AS n
 FROM (SELECT unnest(range(0,256)) AS gx) a, (SELECT unnest(range(0,128)) AS gy) b),
 far AS (SELECT id, gx, gy, (gx = x AND gy = y) AS own, (least(greatest(lat, s), n) - lat) * 111320 AS dy, (least(greatest(lng, w), e) - lng) * 111320 * cos(radians(lat)) AS dx FROM chosen, grid)
 SELECT id, {code_sql('gx', 'gy', 3)} AS cell FROM far WHERE own OR sqrt(dx*dx + dy*dy) <= 300000"""
)
def geo_circle_cells(spark, d):
    p = places(spark, d).where("id % 50 = 0")
    return p.select("id", F.explode(geocells.cells_of_circle(F.col("lat"), F.col("lng"), 300_000.0, 3)).alias("cell"))


@query(
    PLACES
    + """, r AS (SELECT id, lat, lng, 100000.0 * (id % 90) / 6371008.8 AS turn FROM places), w AS (SELECT *, radians(lat) - turn > -pi()/2 AND radians(lat) + turn < pi()/2 AS inside, degrees(asin(least(1.0, sin(turn)/cos(radians(lat))))) AS wide FROM r)
 SELECT id, round(greatest(-90, degrees(radians(lat)-turn)), 6) AS south, round(least(90, degrees(radians(lat)+turn)), 6) AS north,
 round(CASE WHEN NOT inside THEN -180 WHEN lng - wide < -180 THEN lng - wide + 360 ELSE lng - wide END, 6) AS west, round(CASE WHEN NOT inside THEN 180 WHEN lng + wide > 180 THEN lng + wide - 360 ELSE lng + wide END, 6) AS east FROM w"""
)
def geo_radius_box(spark, d):
    p = places(spark, d).withColumn("b", geocells.radius_box(F.col("lat"), F.col("lng"), 100_000.0 * (F.col("id") % 90)))
    return p.select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("south", "north", "west", "east")])


@query(
    PLACES
    + """, s AS (SELECT a.id AS centre, b.id, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lng-a.lng)/2),2) AS a FROM places a, places b WHERE a.id % 20 = 0),
 m AS (SELECT centre, id, 2*6371008.8*atan2(sqrt(a),sqrt(1-a)) AS m FROM s) SELECT centre, id, round(m, 2) AS metres FROM m WHERE m <= 700000 AND m >= 1000"""
)
def geo_join(spark, d):
    """Pairs of every twentieth place and all places 1 to 700 km apart, by cells."""
    p = places(spark, d)
    return geocells.radius_join(p.where("id % 20 = 0").withColumnRenamed("id", "centre"), p, 700_000.0, least=1000.0).select("centre", "id", F.round("distance", 2).alias("metres"))


@query(PLACES + f", n AS (SELECT id, {catalog.NEAR} AS m FROM (SELECT id, pow(sin(radians(lat-(-39.67))/2),2)+cos(radians(-39.67))*cos(radians(lat))*pow(sin(radians(lng-(-49.97))/2),2) AS a FROM places WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 7))) SELECT id, round(m, 2) AS metres FROM n WHERE m <= 500000 ORDER BY m, id LIMIT 100")
def geo_nearby(spark, d):
    p = places(spark, d).withColumnRenamed("c_mktsegment", "type")
    return geocells.nearby(p.join(p.where("id <= 7").select("type").distinct(), "type", "left_semi"), -39.67, -49.97, 500, 500).select("id", F.round("distance", 2).alias("metres"))


@query(cells_sql(4) + f"SELECT count(*) AS entries, count(DISTINCT {code_sql('x', 'y', 4)}) AS cells FROM c")
def geo_stats(spark, d):
    return places(spark, d).agg(F.count("*").alias("entries"), F.countDistinct(geo.geohash(F.col("lat"), F.col("lng"), 4)).alias("cells"))


@query(PLACES + "SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE lat END AS lat, lng FROM places WHERE id % 5 <> 0 AND id % 11 <> 0")
def geo_changed(spark, d):
    """Places without coordinates are left out, those with a known id replaced, some removed."""
    p = places(spark, d).select("id", F.when(F.col("id") % 5 != 0, F.col("lat")).alias("lat"), "lng").dropna(subset=["lat", "lng"])
    moved = storage.upserted(p, p.where("id % 3 = 0").withColumn("lat", F.lit(0.0)), "id")
    return moved.join(p.where("id % 11 = 0").select("id"), "id", "left_anti")


# --- full-text search -------------------------------------------------------------------------------------------

ASKED = "Thing ention ered"


def best_sql(where: str = "true", kept: str = "true") -> str:
    """BM25 in SQL: over the articles that ``where`` leaves, returning those that ``kept`` does."""
    return FTS.replace("FROM documents)", f"FROM documents), all_articles AS (SELECT * FROM articles)", 1).replace("FROM articles UNION", f"FROM articles WHERE {where} UNION").replace("FROM articles))", f"FROM articles WHERE {where}))").replace("(SELECT count(*) FROM articles)", f"(SELECT count(*) FROM articles WHERE {where})") + f""", hits AS (SELECT id, term, count(*) AS tf, max(w) AS w FROM words WHERE term IN ('thing','ention','ered') GROUP BY id, term),
 df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
 SELECT id, round(sum(greatest(0, ln((n-df+0.5)/(df+0.5)+1)) * tf*2.2/(tf+1.2*(0.25+0.75*dl/(total/n))) * w), 6) AS score FROM hits JOIN df USING (term) JOIN sizes USING (id) JOIN all_articles USING (id), corpus WHERE {kept} GROUP BY id ORDER BY score DESC, id LIMIT 20"""


@query(best_sql(kept="type IN ('person','work')"))
def fts_types(spark, d):
    return search.bm25(articles(spark, d), ASKED, 20, stem=False, types=["person", "work"]).select("id", F.round("score", 6).alias("score"))


@query(best_sql())
def fts_index_search(spark, d):
    """The same ranking from a stored index."""
    path = storage.scratch(spark, "fts")
    fts_index.build(articles(spark, d), path, stem=False, buckets=16)
    return fts_index.search(spark, path, ASKED, 20, stem=False, buckets=16).select("id", F.round("score", 6).alias("score"))


@query(best_sql("CAST(id AS BIGINT) % 7 <> 0"))
def fts_index_changed(spark, d):
    """A stored index of half the articles, to which the others are added and from which every seventh is removed."""
    first, second, third = (storage.scratch(spark, "fts") for _ in range(3))
    a = articles(spark, d)
    fts_index.build(a.where("cast(id as bigint) % 2 = 0"), first, stem=False, buckets=16)
    fts_index.added(spark, first, a.where("cast(id as bigint) % 4 <> 2"), second, stem=False, buckets=16)
    fts_index.removed(spark, second, a.where("cast(id as bigint) % 7 = 0"), third, buckets=16)
    return fts_index.search(spark, third, ASKED, 20, stem=False, buckets=16).select("id", F.round("score", 6).alias("score"))


@query(
    ARTICLES
    + f""", l AS (SELECT id, list_filter(list_transform(regexp_extract_all(title, '{text.TOKEN}'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 50) AS ws FROM articles),
 p AS (SELECT id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM l) SELECT id, term, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM p WHERE NOT list_contains({catalog.STOP}, term) GROUP BY id, term"""
)
def fts_positions(spark, d):
    """Stop-words are no terms, but they count in positions."""
    return search.postings(articles(spark, d).select("id", "title"), stem=False).select("id", "term", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


# --- lookups ----------------------------------------------------------------------------------------------------

KEY_SQL = r"trim(regexp_replace(replace(lower(title),'_',' '), '\s+', ' ', 'g'))"


def latest() -> list:
    return [F.desc(F.col("id").cast("long"))]


@query(ARTICLES + f"SELECT {KEY_SQL} AS key, arg_max(id, CAST(id AS BIGINT)) AS id, arg_max(type, CAST(id AS BIGINT)) AS type FROM articles WHERE title <> '' GROUP BY 1")
def title_index(spark, d):
    return indexes.title_index(articles(spark, d), latest())


@query(ARTICLES + "SELECT type, count(*) AS size FROM articles GROUP BY type")
def type_index(spark, d):
    return indexes.type_index(indexes.id_index(articles(spark, d), latest()))


@query(ARTICLES + "SELECT CAST(s_suppkey * 13 AS VARCHAR) AS id, a.id IS NOT NULL AS present FROM supplier LEFT JOIN (SELECT * FROM articles WHERE type <> 'org') a ON a.id = CAST(s_suppkey * 13 AS VARCHAR)")
def id_presence(spark, d):
    asked = t(spark, d, "supplier").select((F.col("s_suppkey") * 13).cast("string").alias("id"))
    return indexes.with_presence(asked, indexes.id_index(articles(spark, d), latest()).where("type <> 'org'"))


@query("WITH k AS (SELECT lower(p_name) AS key, max(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT p_partkey, k.id FROM part LEFT JOIN k ON lower(p_name) = key")
def title_lookup(spark, d):
    """Titles are asked of a filter before they are looked up."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    index = indexes.title_index(p.where("p_partkey % 3 = 0").select("title", F.col("p_partkey").alias("id"), F.lit("other").alias("type")), [F.desc("id")])
    names = indexes.looked_up(p.select("title").distinct(), index, 2000)
    return p.join(names, "title", "left").select("p_partkey", "id")


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: xor(h, c) * 16777619 % 4294967296)"
SQL["term_hashes"] = "SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS djb2 FROM part"


@query(f"SELECT p_partkey, 'article' AS kind, lpad(CAST({FNV.format('lower(p_name)')} % 1000 AS VARCHAR), 4, '0') AS partition, {FNV.format('lower(p_name)')} AS hash FROM part")
def article_places(spark, d):
    return t(spark, d, "part").select("p_partkey", text.article_place(F.col("p_name")).alias("p")).select("p_partkey", "p.*")


@query(f"WITH h AS (SELECT {FNV.format('p_name')} AS a, {FNV.format('p_name || p_name')} AS b FROM part), p AS (SELECT unnest(list_transform(range(0, 7), lambda i: (a + i * b) % 20000)) AS bit FROM h) SELECT count(DISTINCT bit) AS bits FROM p")
def filter_bits(spark, d):
    return hashes.bloom_filter(t(spark, d, "part"), "p_name", lambda c: hashes.title_positions(c, 2000)).agg(F.count("*").alias("bits"))


# --- results, pages and counters --------------------------------------------------------------------------------


@query(ARTICLES + "SELECT id, type, count(*) OVER () AS total, count(*) OVER () > 60 AS has_more FROM articles WHERE type = 'place' ORDER BY n_chars, id LIMIT 20 OFFSET 40")
def page_with_total(spark, d):
    return storage.paged(articles(spark, d).where("type = 'place'").select("id", "type", "n_chars"), [F.col("n_chars"), F.col("id")], 20, 40).select("id", "type", "total", "has_more")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) SELECT r // 64 AS batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM n GROUP BY 1")
def batches(spark, d):
    b = storage.batched(t(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 64)
    return b.select("batch", F.size("items").cast("long").alias("n"), F.element_at("items", 1)["doc_id"].alias("first"), F.element_at("items", -1)["doc_id"].alias("last"))


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 30")
def first_articles(spark, d):
    return t(spark, d, "pages").orderBy("page_id").limit(30).select("page_id", "url")


@query(ARTICLES + "SELECT id, type, upper(type) || ':' || title AS label FROM articles WHERE type IN ('person','event') AND NOT contains(lower(title), 'redirect') AND CAST(id AS BIGINT) % 4 <> 1")
def pipeline_articles(spark, d):
    """Redirects are skipped, types chosen, and each article mapped."""
    a = articles(spark, d).withColumn("is_redirect", F.contains(F.lower("title"), F.lit("redirect")) | (F.col("id").cast("long") % 4 == 1))
    return a.where(~F.col("is_redirect") & F.col("type").isin("person", "event")).select("id", "type", F.concat(F.upper("type"), F.lit(":"), "title").alias("label"))


@query(ARTICLES + "SELECT count(*) AS articles, sum(n_chars) AS chars, count(DISTINCT type) AS types, count(*) FILTER (type = 'work') AS works, count(*) FILTER (n_chars < 300) AS skipped, round(count(*) FILTER (n_chars < 300) / count(*), 6) AS skip_rate FROM articles")
def ingest_totals(spark, d):
    short = F.count_if(F.col("n_chars") < 300)
    return articles(spark, d).agg(F.count("*").alias("articles"), F.sum("n_chars").alias("chars"), F.countDistinct("type").alias("types"), F.count_if(F.col("type") == "work").alias("works"), short.alias("skipped"), F.round(short / F.count("*"), 6).alias("skip_rate"))


@query(ARTICLES + "SELECT map(list(type ORDER BY type), list(CAST(n AS VARCHAR) ORDER BY type))::VARCHAR AS counts FROM (SELECT type, count(*) AS n FROM articles GROUP BY type)")
def type_counts(spark, d):
    n = articles(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.concat("type", F.lit("="), F.col("n").cast("string"))))
    return n.agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("counts"))


@query("SELECT user_id, sum(CASE WHEN event_type IN ('view','signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS gauge, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def gauge_moves(spark, d):
    """A gauge that goes up and down, and a running mean."""
    step = F.when(F.col("event_type").isin("view", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return t(spark, d, "events").groupBy("user_id").agg(F.sum(step).alias("gauge"), F.round(F.avg("value"), 6).alias("mean"))


@query(LOG + "SELECT endpoint, count(*) AS n, round(sum(latency), 4) AS total, " + ", ".join(f"count(*) FILTER (latency <= {b}) AS le_{b}" for b in catalog.BOUNDS) + " FROM log GROUP BY endpoint")
def histogram_sums(spark, d):
    return log(spark, d).groupBy("endpoint").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 4).alias("total"), *[F.count_if(F.col("latency") <= b).alias(f"le_{b}") for b in catalog.BOUNDS])


@query(LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS r FROM log) SELECT endpoint, status, count(*) AS requests, quantile_disc(latency, 0.5) FILTER (r <= 1000) AS p50, quantile_disc(latency, 0.95) FILTER (r <= 1000) AS p95, quantile_disc(latency, 0.99) FILTER (r <= 1000) AS p99 FROM r GROUP BY endpoint, status")
def recent_rollup(spark, d):
    """Requests by endpoint and status; percentiles of the last 1000 of an endpoint."""
    w = Window.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id"))
    every = log(spark, d)
    last = every.withColumn("r", F.row_number().over(w)).where("r <= 1000").groupBy("endpoint", "status")
    p = [F.expr(f"percentile_disc({q / 100}) within group (order by latency)").alias(f"p{q}") for q in (50, 95, 99)]
    return every.groupBy("endpoint", "status").agg(F.count("*").alias("requests")).join(last.agg(*p), ["endpoint", "status"], "left")


PAGE_KEY = r"trim(regexp_replace(replace(lower(regexp_extract({0}, '([^/]*)/?$', 1)),'_',' '), '\s+', ' ', 'g'))"


@query(catalog.HREFS + f"""
, named AS (SELECT page_id, {PAGE_KEY.format('regexp_extract(html, ' + chr(39) + '<a href=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34) + chr(39) + ', 1)')} AS key FROM pages), l AS (SELECT page_id AS src, {PAGE_KEY.format('href')} AS key FROM links) SELECT n.page_id, count(DISTINCT l.src) AS backlinks FROM named n JOIN l ON l.key = n.key AND l.src <> n.page_id GROUP BY n.page_id""")
def backlinks_by_title(spark, d):
    """Links that normalise to a page's title (its first link's), its own left out."""
    key = lambda c: text.title_key(F.regexp_extract(c, "([^/]*)/?$", 1))
    named = t(spark, d, "pages").select("page_id", key(F.regexp_extract("html", '<a href="([^"]*)"', 1)).alias("key"))
    links = catalog.hrefs(spark, d).select(F.col("page_id").alias("src"), key("href").alias("key")).distinct()
    return named.join(links, "key").where("src <> page_id").groupBy("page_id").agg(F.count("*").alias("backlinks"))


@query("SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red' THEN 1.0 WHEN starts_with(lower(p_name), 'red') THEN 0.8 ELSE 0.5 END AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'red')")
def plain_title_scores(spark, d):
    return t(spark, d, "part").select("p_partkey", text.plain_title_score(F.col("p_name"), " RED ").alias("score")).where("score is not null")


@query("SELECT doc_id, length(CASE WHEN length(text) <= 300 THEN text WHEN position(' ' IN reverse(substr(text,1,300))) BETWEEN 1 AND 99 THEN substr(text, 1, 300 - position(' ' IN reverse(substr(text,1,300)))) ELSE substr(text,1,300) END) AS n FROM documents")
def cut_texts(spark, d):
    from tessera.functions.embedding import cut_at_space

    return t(spark, d, "documents").select("doc_id", F.length(cut_at_space(F.col("text"), 300)).cast("long").alias("n"))


@query()
def term_variants(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(text.term_variants("p_name"), "|").alias("variants"))


@query("SELECT p_partkey, lower(p_name) = lower(p_type) AS same FROM part")
def term_matches(spark, d):
    return t(spark, d, "part").select("p_partkey", text.terms_match(F.col("p_name"), F.col("p_type")).alias("same"))


@query("SELECT DISTINCT p_name FROM part WHERE p_name >= 'r' AND p_name < 's'")
def sorted_terms(spark, d):
    """A range of a stored table of sorted terms."""
    path = storage.scratch(spark, "terms")
    storage.write_terms(t(spark, d, "part").select(F.col("p_name").alias("term")).distinct(), path)
    return spark.read.parquet(path).where("term >= 'r' and term < 's'").select(F.col("term").alias("p_name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'gzip' WHEN page_id % 3 = 1 THEN 'bzip2' ELSE 'auto' END AS codec, 'b' || page_id AS name FROM pages")
def file_codecs(spark, d):
    ending = F.when(F.col("page_id") % 3 == 0, ".GZ").when(F.col("page_id") % 3 == 1, ".bz2").otherwise(".xml")
    tag = F.concat(F.lit('<page name="a" id="7" name="b'), "page_id", F.lit('">'))
    return t(spark, d, "pages").select("page_id", storage.codec_of(F.concat("url", ending)).alias("codec"), F.element_at(storage.attributes(tag), "name").alias("name"))


@query(ARTICLES + "SELECT type, count(*) AS rows FROM articles GROUP BY type")
def stored_manifest(spark, d):
    """Rows of each type from the files of a stored table, none of which is empty."""
    path = storage.scratch(spark, "articles")
    storage.write_partitioned(articles(spark, d), path)
    return storage.manifest(spark.read.parquet(path)).where("files > 0 and bytes > 0").select("type", "rows")


@query("SELECT n_nationkey AS id, n_name AS title, CAST(n_nationkey AS BIGINT) * 1000 AS population, n_name AS capital FROM nation")
def shredded_boxes(spark, d):
    path = storage.scratch(spark, "boxes")
    n = t(spark, d, "nation")
    box = F.create_map(F.lit("population"), (F.col("n_nationkey") * 1000).cast("string"), F.lit("capital"), "n_name")
    storage.write_shredded(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), box.alias("infobox")), path, {"population": "bigint"})
    return spark.read.parquet(path).select("id", "title", F.col("box_population").alias("population"), F.variant_get("infobox", "$.capital", "string").alias("capital"))


@query("SELECT f.form, count(*) AS lines FROM nation, (SELECT unnest(['csv','json','parquet']) AS form) f GROUP BY f.form")
def all_forms(spark, d):
    paths = storage.write_all_forms(t(spark, d, "nation"), storage.scratch(spark, "forms"))
    read = {"parquet": spark.read.parquet, "json": spark.read.json, "csv": spark.read.text}
    parts = [read[form](p).select(F.lit(form).alias("form")) for p in paths for form in [p.rpartition("/")[2]]]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("form").agg(F.count("*").alias("lines"))


# --- vectors ----------------------------------------------------------------------------------------------------

FAR = "sqrt(list_sum(list_transform(list_zip(e,q), lambda p: (p[1]-p[2])*(p[1]-p[2]))))"


@query(VEC + f"SELECT id, round({FAR}, 6) AS distance, round(exp(-{FAR}), 6) AS score FROM v, q ORDER BY {FAR}, id LIMIT 10")
def knn_euclidean(spark, d):
    v, q = embedded(spark, d)
    far = F.sqrt(vectors.squared_l2(F.col("embedding"), knn.literal(q)))
    return v.withColumn("m", far).orderBy("m", "id").limit(10).select("id", F.round("m", 6).alias("distance"), F.round(vectors.euclidean_score(F.col("m")), 6).alias("score"))


@query(VEC + ", c AS (SELECT count(*) AS n, count(*) FILTER (label IN (1,2)) AS c FROM v), b AS (SELECT id, label, list_dot_product(e,q) AS s FROM v, q) SELECT id, round(s, 6) AS score, CASE WHEN c = 0 THEN 'post' WHEN c < 20 OR c / n < 0.3 THEN 'pre' ELSE 'post' END AS strategy FROM b, c WHERE label IN (1,2) ORDER BY s DESC, id LIMIT 10")
def knn_strategy(spark, d):
    """The filter goes before the ranking either way; which way an index would choose is told."""
    v, q = embedded(spark, d)
    c = v.agg(F.count("*").alias("n"), F.count_if(F.col("label").isin(1, 2)).alias("c"))
    way = F.when(F.col("c") == 0, "post").when((F.col("c") < 20) | (F.col("c") / F.col("n") < 0.3), "pre").otherwise("post")
    near = knn.nearest(v.where("label in (1,2)"), q, 10, "dot")
    return near.join(F.broadcast(c), F.lit(True)).select("id", F.round("score", 6).alias("score"), way.alias("strategy"))  # one row of counts


@query("SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id % 9 <> 0 UNION ALL SELECT vec_id + 1000000, 7 FROM embeddings WHERE vec_id % 50 = 0")
def vectors_changed(spark, d):
    """Upserts replace or add, vectors of another size are refused, some ids are removed."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    new = v.where("id % 4 = 0").withColumn("label", F.lit(99)).unionByName(v.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lit(7).alias("label"), "embedding"))
    new = new.unionByName(v.where("id % 50 = 0").select((F.col("id") + 2_000_000).alias("id"), "label", F.slice("embedding", 1, 3).alias("embedding")))
    out = storage.upserted(v, new.where(F.size("embedding") == 64), "id")
    return out.join(v.where("id % 9 = 0").select("id"), "id", "left_anti").select("id", "label")


@query(
    VEC
    + """, a AS (SELECT id, row_number() OVER (ORDER BY list_dot_product(e,q) DESC, id) - 1 AS r FROM v, q QUALIFY r < 20), b AS (SELECT id, row_number() OVER (ORDER BY list_dot_product(e[1:32],q[1:32]) DESC, id) - 1 AS r FROM v, q QUALIFY r < 20)
 SELECT id, round(sum(p), 8) AS score, count(*) AS models FROM (SELECT id, 1.0/(61+r) AS p FROM a UNION ALL SELECT id, 1.0/(61+r) FROM b) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10"""
)
def multi_model_rrf(spark, d):
    """Rankings of two models fused; the second knows half of the components."""
    v, q = embedded(spark, d)
    half = v.select("id", "label", F.slice("embedding", 1, 32).alias("embedding"))
    lists = {"whole": (search.ranked(knn.nearest(v, q, 20, "dot"), F.desc("score")), 1.0), "half": (search.ranked(knn.nearest(half, q[:32], 20, "dot"), F.desc("score")), 1.0)}
    return search.fused(lists, 10).select("id", F.round("score", 8).alias("score"), F.size("sources").cast("long").alias("models"))


@query(
    f"""SELECT id, round(sum(p), 8) AS score, array_to_string(list(name ORDER BY name), '+') AS sources FROM (
 SELECT id, 0.5/(60+row_number() OVER (ORDER BY score DESC, id)) AS p, 'text' AS name FROM ({best_sql()})
 UNION ALL SELECT id, 0.5/(60+r), 'vector' FROM ({VEC} SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY list_dot_product(e,q) DESC, CAST(id AS VARCHAR)) AS r FROM v, q QUALIFY r <= 20)) GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10"""
)
def hybrid_search(spark, d):
    """Full-text and vector rankings of the same articles, fused; ``sources`` tells which lists hold an article."""
    v, q = embedded(spark, d)
    found = search.ranked(search.bm25(articles(spark, d), ASKED, 20, stem=False), F.desc("score"))
    near = search.ranked(knn.nearest(v.withColumn("id", F.col("id").cast("string")), q, 20, "dot"), F.desc("score"))
    return search.fused({"text": (found, 0.5), "vector": (near, 0.5)}, 10).select("id", F.round("score", 8).alias("score"), F.array_join("sources", "+").alias("sources"))


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dim, max(len(embedding)) AS widest FROM embeddings GROUP BY label")
def vector_stats(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"), F.max(F.size("embedding")).cast("long").alias("widest"))


@query("SELECT vec_id AS id, label AS type, 'm' || CAST(vec_id % 2 AS VARCHAR) AS model FROM embeddings")
def stored_vectors(spark, d):
    path = storage.scratch(spark, "vectors")
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), F.lit(1).alias("batch"))
    storage.write_vectors(v.unionByName(v.withColumn("batch", F.lit(0)).withColumn("type", F.lit(77))), path, [F.desc("batch")])
    return spark.read.parquet(path).select("id", F.col("type").cast("int").alias("type"), "model")


NEAR_SQL = "(SELECT DISTINCT p_name AS id, len(list_intersect(string_split(p_name, ' '), string_split('{0}', ' '))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split('{0}', ' ')))) AS score FROM part)"


def tier_sql(asked: str, k: int) -> str:
    return f"""SELECT '{asked}' AS asked, id, round(score, 6) AS score, source FROM (WITH a AS (SELECT id, score FROM {NEAR_SQL.format(asked)} WHERE score > 0 ORDER BY score DESC, id LIMIT {k}),
 b AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings ORDER BY score DESC, id LIMIT {k}),
 s AS (SELECT CASE WHEN (SELECT count(*) FROM a) >= {k} AND (SELECT max(score) FROM a) > 0.9 THEN 'inline' WHEN (SELECT count(*) FROM b) > 0 THEN 'cached' ELSE 'partial' END AS source)
 SELECT id, score, source FROM a, s WHERE source <> 'cached' UNION ALL SELECT id, score, source FROM b, s WHERE source = 'cached')"""


@query(" UNION ALL ".join(tier_sql(q, 5) for q in ("red widget", "no such words")))
def tiered_search(spark, d):
    """Names that share words with the question; where they are too few or too far, the nearest vectors."""
    v, q = embedded(spark, d)
    vectors_ = knn.nearest(v.withColumn("id", F.col("id").cast("string")), q, 5, "dot").select("id", "score")
    names = t(spark, d, "part").select(F.col("p_name").alias("id")).distinct()
    parts = []
    for asked in ("red widget", "no such words"):
        near = names.withColumn("score", search.word_jaccard(F.col("id"), F.lit(asked))).where("score > 0")
        parts.append(search.tiered(near, vectors_, 5).select(F.lit(asked).alias("asked"), "id", F.round("score", 6).alias("score"), "source"))
    return parts[0].unionByName(parts[1])


DOT = "list_dot_product(e,q)"


@query(VEC + f", near AS (SELECT id, label, {DOT} AS s FROM v, q ORDER BY s DESC, id LIMIT 50) SELECT id, round(s, 6) AS score FROM near WHERE label IN (1,2) ORDER BY s DESC, id LIMIT 10")
def knn_post_filter(spark, d):
    """The filter after 50 candidates: fewer than ten may be left."""
    v, q = embedded(spark, d)
    return knn.nearest(v, q, 50, "dot").where("label in (1,2)").orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@query(VEC + f"SELECT id, round({DOT}, 6) AS score FROM v, q WHERE id IN (SELECT p_partkey FROM part WHERE p_size > 25) AND {DOT} >= 0.05 ORDER BY {DOT} DESC, id LIMIT 10")
def knn_of_ids(spark, d):
    """Only ids of another table, and only scores from a least one on."""
    v, q = embedded(spark, d)
    some = v.join(t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return knn.nearest(some, q, 10, "dot").where("score >= 0.05").select("id", F.round("score", 6).alias("score"))


@query("SELECT n_nationkey AS id, n_name || ' in ' || n_nationkey || '.' AS summary, 1 AS boxes, 1 AS links, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey")
def wiki_parts(spark, d):
    """The parts of an article that are asked for by name: summary, infobox, links, categories."""
    doc = catalog.wiki(spark, d).withColumn("d", wikidoc.document(F.lit("T"), F.col("w"), date(2024, 6, 15)))
    return doc.select("id", F.col("d.summary").alias("summary"), F.size("d.infoboxes").alias("boxes"), F.size("d.links").alias("links"), F.element_at("d.categories", 1).alias("category"))


# --- results of folds and strings, stated for queries of the catalog ------------------------------------------------

STEPS = "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), "
SQL["rate_limit_admission"] = STEPS + """s AS (SELECT user_id, event_id, ms, r, true AS allowed, [ms] AS kept FROM o WHERE r = 1 UNION ALL
 SELECT user_id, event_id, ms, r, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, ms) ELSE kept END FROM (SELECT o.user_id, o.event_id, o.ms, o.r, list_filter(s.kept, lambda k: k > o.ms - 86400000) AS kept FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1))
 SELECT user_id, ms, event_id, allowed FROM s"""
SQL["fixed_window_admission"] = STEPS + """s AS (SELECT user_id, event_id, ms, r, ms AS start, 1 AS n FROM o WHERE r = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.ms, o.r, CASE WHEN o.ms - s.start >= 86400000 THEN o.ms ELSE s.start END, CASE WHEN o.ms - s.start >= 86400000 THEN 1 ELSE s.n + 1 END FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1)
 SELECT user_id, ms, event_id, n <= 3 AS allowed FROM s"""
SQL["circuit_breaker"] = STEPS + """s AS (SELECT user_id, event_id, r, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS bad, 0 AS good, 0::BIGINT AS opened FROM o WHERE r = 1 UNION ALL
 SELECT user_id, event_id, r, CASE WHEN was = 'closed' THEN CASE WHEN NOT ok AND bad + 1 >= 5 THEN 'open' ELSE 'closed' END WHEN was = 'half-open' THEN CASE WHEN NOT ok THEN 'open' WHEN good + 1 >= 3 THEN 'closed' ELSE 'half-open' END ELSE was END,
  CASE WHEN was = 'closed' THEN CASE WHEN ok THEN 0 ELSE bad + 1 END WHEN was = 'half-open' AND ok AND good + 1 >= 3 THEN 0 ELSE bad END, CASE WHEN was = 'half-open' THEN CASE WHEN ok THEN good + 1 ELSE 0 END ELSE good END,
  CASE WHEN NOT ok AND (was = 'half-open' OR was = 'closed' AND bad + 1 >= 5) THEN ms ELSE opened END
 FROM (SELECT o.user_id, o.event_id, o.r, o.ms, o.ok, s.bad, s.opened, CASE WHEN s.state = 'open' AND o.ms - s.opened >= 30000 THEN 0 ELSE s.good END AS good, CASE WHEN s.state = 'open' AND o.ms - s.opened >= 30000 THEN 'half-open' ELSE s.state END AS was FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1))
 SELECT user_id, event_id, state FROM s"""
SQL["title_scores"] = """WITH k AS (SELECT p_partkey, trim(lower(p_name)) AS t, 'red tin' AS q FROM part), f AS (SELECT *, len(list_intersect(string_split(t, ' '), ['red','tin'])) AS found, levenshtein(t, q) / greatest(length(t), length(q), 1) AS far FROM k)
 SELECT p_partkey, CAST(CASE WHEN t = q THEN 1.0 WHEN starts_with(t, q) THEN 0.9 WHEN contains(t, q) THEN 0.7 WHEN found > 0 THEN 0.5 * found / 2 WHEN far < 0.3 THEN round(0.3 * (1 - far), 6) ELSE 0.0 END AS DOUBLE) AS score FROM f"""
SQL["normalised_terms"] = ARTICLES + r"SELECT id, substr(trim(regexp_replace(strip_accents(replace(replace(replace(replace(lower(title), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')), '[^\p{L}\p{N}]+', ' ', 'g')), 1, 256) AS term FROM articles"
SQL["fuzzy_terms"] = "WITH n AS (SELECT DISTINCT p_name FROM part), j AS (SELECT a.p_name AS a, b.p_name AS b, jaro_similarity(a.p_name, b.p_name) AS j, CASE WHEN substr(a.p_name, 1, 4) = substr(b.p_name, 1, 4) THEN 0.4 ELSE 0.3 END AS head FROM n a JOIN n b ON substr(a.p_name, 1, 3) = substr(b.p_name, 1, 3) AND a.p_name < b.p_name) SELECT a, b, round(j + head * (1 - j), 6) AS score FROM j WHERE j + head * (1 - j) >= 0.8"

NAMES = [n for n in QUERIES if n not in BEFORE] + ["geohashes", "term_hashes"]
