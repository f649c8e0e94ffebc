"""Registered queries of the longer chains: near matches, pages and admission, publishing, structuring, streams."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import facts, fixed, geo, similarity, text
from tidewell.operators import freshness, resolve, serve, similar, structure
from tidewell.schemas import CANDIDATE, assert_contract
from tidewell.sources import envelopes, keyed, landing, normalize, raw
from tidewell.streaming import stream
from tidewell.tables import shared_dir, table, written

from .publish import JOBS, LINKS, publish_latest_raw, publish_stream
from .queries import CLASSIFIED, COMPANY, IDENTITY, LOCATION, NOW, PUB, SPACED, TEXT_KEY, TOK, BARE, _all_envelopes, _envelopes, _jobs_snapshot, _responses, query
from .views import view

# --- near matches ---------------------------------------------------------------------------------------------------

#: Longest common subsequences of pairs lp (id, a, b; a of at most 120 characters), bit-parallel: one row a character of b.
LCS = """lr AS (WITH RECURSIVE r AS (SELECT id, a, b, 0 AS i, (CAST(1 AS HUGEINT) << length(a)) - 1 AS row FROM lp
 UNION ALL SELECT id, a, b, i + 1, ((row + hit) | (row - hit)) & ((CAST(1 AS HUGEINT) << length(a)) - 1) FROM
 (SELECT *, row & CAST(coalesce(list_sum(list_transform(range(length(a)), lambda k: CASE WHEN substr(a, CAST(k AS INT) + 1, 1) = substr(b, i + 1, 1) THEN CAST(1 AS HUGEINT) << CAST(k AS INT) ELSE CAST(0 AS HUGEINT) END)), 0) AS HUGEINT) AS hit FROM r WHERE i < length(b)))
SELECT id, length(a) - bit_count(row) AS lcs FROM r WHERE i = length(b))"""
KEYS = f"k AS (SELECT candidate_id AS id, {COMPANY.format('company_name')} AS company, {TOK.format('title')} AS t, {LOCATION.format('location')} AS loc, string_split({TEXT_KEY.format('description')}, ' ') AS s FROM postings_v)"
#: Pairs p (ca, jb, t1, t2, s1, s2) with both ratios.
RATIOS = f"""q AS (SELECT *, list_sort(list_filter(s1, lambda x: list_contains(s2, x))) AS core, list_sort(list_filter(s1, lambda x: NOT list_contains(s2, x))) AS r1, list_sort(list_filter(s2, lambda x: NOT list_contains(s1, x))) AS r2 FROM p),
w AS (SELECT *, array_to_string(core, ' ') AS c, array_to_string(r1, ' ') AS x1, array_to_string(r2, ' ') AS x2 FROM q),
lp AS (SELECT DISTINCT t1 || chr(9) || t2 AS id, t1 AS a, t2 AS b FROM w UNION SELECT x1 || chr(9) || x2, x1, x2 FROM w), {LCS},
z AS (SELECT w.*, CASE WHEN length(t1) + length(t2) = 0 THEN 100.0 ELSE 200.0 * lt.lcs / (length(t1) + length(t2)) END AS ratio, length(c) + CASE WHEN c = '' THEN 0 ELSE 1 END AS cg, lx.lcs AS lx FROM w JOIN lr lt ON lt.id = t1 || chr(9) || t2 JOIN lr lx ON lx.id = x1 || chr(9) || x2),
m AS (SELECT *, CASE WHEN c <> '' AND (x1 = '' OR x2 = '') THEN 100.0 ELSE greatest(200.0 * (cg + lx) / (2 * cg + length(x1) + length(x2)), CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + cg + length(x1)) ELSE 0 END, CASE WHEN c <> '' THEN 200.0 * length(c) / (length(c) + cg + length(x2)) ELSE 0 END) END AS set_ratio FROM z)
"""
GENERIC = ", ".join(f"'{t}'" for t in fixed.GENERIC_LOCATION_TOKENS)
PLACES = f"""(a.loc = b.loc OR (len(list_filter(string_split(a.loc, ' '), lambda x: list_contains(string_split(b.loc, ' '), x) AND x NOT IN ({GENERIC}))) > 0
 AND (list_has_all(string_split(a.loc, ' '), string_split(b.loc, ' ')) OR list_has_all(string_split(b.loc, ' '), string_split(a.loc, ' ')))))"""
NEAR = f"+ {KEYS}, p AS (SELECT a.id AS ca, b.id AS jb, a.t AS t1, b.t AS t2, a.s AS s1, b.s AS s2 FROM k a JOIN k b ON a.company = b.company AND a.id % 2 = 0 AND b.id % 2 = 1 AND {PLACES}), {RATIOS}, f AS (SELECT ca, jb FROM m WHERE ratio >= {fixed.TITLE_THRESHOLD} AND set_ratio >= {fixed.DESCRIPTION_THRESHOLD})\n"


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings made of parts, every other one as a job that is known."""
    p = resolve.with_identity(view(spark, sf_dir, "postings_v"))
    return p.where("candidate_id % 2 = 0"), p.where("candidate_id % 2 = 1").withColumnRenamed("candidate_id", "job_id")


@query(f"+ {KEYS}, g AS (SELECT id, t, s, lag(t) OVER v AS t0, lag(s) OVER v AS s0 FROM k WINDOW v AS (PARTITION BY company ORDER BY id)), p AS (SELECT id AS ca, 0 AS jb, t AS t1, t0 AS t2, s AS s1, s0 AS s2 FROM g WHERE t0 IS NOT NULL), {RATIOS} SELECT ca AS candidate_id, ratio, set_ratio FROM m", "postings_v")
def title_ratios(spark, sf_dir):
    """Each posting's title and text against those of the posting before it of the same company."""
    c = resolve.with_identity(view(spark, sf_dir, "postings_v"))
    w = Window.partitionBy("company_key").orderBy("candidate_id")
    pairs = c.select("candidate_id", "title_key", "text_key", F.lag("title_key").over(w).alias("t2"), F.lag("text_key").over(w).alias("x2")).where("t2 is not null")
    return pairs.select("candidate_id", similarity.indel_ratio("title_key", "t2").alias("ratio"), similarity.token_set_ratio("text_key", "x2").alias("set_ratio"))


@query(NEAR + "SELECT ca AS candidate_id, jb AS job_id FROM f", "postings_v")
def match_fuzzy(spark, sf_dir):
    return resolve.fuzzy_pairs(*_postings(spark, sf_dir))


OWN = IDENTITY.replace("candidates_v", "postings_v").replace("% 3 = 0", "% 2 = 0").replace("% 3 <> 0", "% 2 = 1").lstrip("+ ").replace("c AS (", "cc AS (").replace("j AS (SELECT candidate_id AS job_id, *", "jj AS (SELECT candidate_id AS job_id, *")


@query(NEAR.rstrip() + ", " + OWN.rstrip() + """,
h AS (SELECT cc.candidate_id AS c, 1 AS p, jj.job_id AS j FROM cc JOIN jj ON cc.pk = jj.pk UNION ALL SELECT cc.candidate_id, 2, jj.job_id FROM cc JOIN jj ON cc.fp = jj.fp UNION ALL SELECT cc.candidate_id, 3, jj.job_id FROM cc JOIN jj ON cc.uk = jj.uk
 UNION ALL SELECT cc.candidate_id, 4, jj.job_id FROM cc JOIN jj ON cc.rk = jj.rk UNION ALL SELECT ca, 5, jb FROM f),
b AS (SELECT c, p, j, row_number() OVER (PARTITION BY c ORDER BY p, j) AS n FROM h)
SELECT cc.candidate_id, b.j AS job_id, ['link', 'fingerprint', 'url', 'exact', 'fuzzy'][b.p] AS how FROM cc LEFT JOIN b ON b.c = cc.candidate_id AND b.n = 1""", "postings_v")
def resolve_rows(spark, sf_dir):
    c, j = _postings(spark, sf_dir)
    links = j.where("source_job_id is not null").groupBy("source_id", "source_job_id").agg(F.min("job_id").alias("job_id"))
    return resolve.resolve_identity(c, j, links)


@query(f"""WITH t AS (SELECT DISTINCT {TOK.format("(p_name || ' ' || p_type || CASE WHEN p_size % 10 = 0 THEN ' jr' ELSE '' END)")} AS t FROM part),
p AS (SELECT a.t AS t1, b.t AS t2 FROM t a JOIN t b ON a.t < b.t AND 27 * least(length(a.t), length(b.t)) >= 23 * greatest(length(a.t), length(b.t))),
lp AS (SELECT t1 || chr(9) || t2 AS id, t1 AS a, t2 AS b FROM p), {LCS}
SELECT t1 AS a_title, t2 AS b_title FROM p JOIN lr ON lr.id = t1 || chr(9) || t2 WHERE 200.0 * lcs / (length(t1) + length(t2)) >= {fixed.TITLE_THRESHOLD}""")
def near_titles(spark, sf_dir):
    """Titles of parts that are near each other, with one company for all rows."""
    title = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 10 == 0, "jr"))
    rows = table(spark, sf_dir, "part").select(F.lit("one").alias("company_key"), text.normalize_title(title).alias("title_key")).distinct()
    found = similar.near_titles(rows.withColumns({"a": F.lit(True), "b": F.lit(True)}))
    return found.where("a_title < b_title").select("a_title", "b_title")


@query(NEAR.replace("a.id % 2 = 0 AND b.id % 2 = 1", "a.id <> b.id") + """, e AS (SELECT ca AS u, jb AS v FROM f),
groups AS (WITH RECURSIVE r AS (SELECT u AS n, u AS l FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.n AND r.l < e.v) SELECT n, min(l) AS l FROM r GROUP BY 1)
SELECT k.id AS candidate_id, coalesce(g.l, k.id) AS cluster FROM k LEFT JOIN groups g ON g.n = k.id""", "postings_v")
def near_clusters(spark, sf_dir):
    """Groups of postings that hang together by likeness alone."""
    return resolve.clusters(resolve.with_identity(view(spark, sf_dir, "postings_v")), keys=())


# --- pages, boards and admission -----------------------------------------------------------------------------------


#: Entities that occur in the pages, the ampersand last.
DECODED = "replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, {SPACED.format(DECODED.format(BARE))} AS body, {SPACED.format('regexp_replace(' + DECODED.format('html') + ', ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS plain FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text("html").alias("body"), text.plain_text("html").alias("plain"))


@query("SELECT 'k' || doc_id AS source_external_key, CASE WHEN doc_id % 3 = 0 THEN 'accepted' WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'account name differs' END AS verdict FROM documents")
def account_names(spark, sf_dir):
    """Responses that name their account, against the name that the source table expects (none, the same, another)."""
    d = table(spark, sf_dir, "documents").select(F.lit("workable").alias("source_type"), F.concat(F.lit("k"), "doc_id").alias("source_external_key"), "doc_id", "source", "text")
    bodies = d.select("source_type", "source_external_key", F.to_json(F.struct(F.col("source").alias("name"), "text")).alias("body"))
    expected = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "source")).when(F.col("doc_id") % 3 == 2, "Other Ltd")
    good, bad = envelopes.account_name_check(bodies, d.select("source_type", "source_external_key", expected.alias("company_name")))
    return good.select("source_external_key", F.lit("accepted").alias("verdict")).unionByName(bad.select("source_external_key", F.col("error").alias("verdict")))


@query("SELECT DISTINCT 'https://sm/' || page_id // 100 AS root, url FROM pages UNION SELECT 'https://sm/' || page_id // 100, 'https://sm/other/' || page_id // 100 FROM pages")
def sitemap_pages(spark, sf_dir):
    """Sitemaps of a hundred pages, each under an index of its own; beside it in the index a sitemap that is not called one, so
    a page, and a page that is called one, so passed over."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("n", F.expr("page_id div 100"))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = p.groupBy("n").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("html"))
    part, other, page = (F.concat(F.lit(f"https://sm/{kind}/"), "n", F.lit(end)) for kind, end in (("part", ".XML?v=1"), ("other", ""), ("none", ".xml")))
    index = maps.select(F.concat(F.lit("https://sm/"), "n").alias("url"), F.concat(F.lit("<sitemapindex><loc>"), F.concat_ws("</loc><loc>", part, other, page), F.lit("</loc></sitemapindex>")).alias("html"))
    every = [maps.select(part.alias("url"), "html"), maps.select(other.alias("url"), "html"), maps.select(page.alias("url"), F.lit("<p>no map</p>").alias("html")), index, p.select("url", "html").dropDuplicates(["url"])]
    pages = reduce(DataFrame.unionByName, every).withColumn("content_type", F.lit("text/html"))
    return envelopes.sitemap_expand(pages, index.select("url")).select("root", "url")


#: Robots snapshots of an origin: one every six hours from the first of March 2024, status and rules by its number and the origin's length.
SHOTS = 100


@query(f"""WITH p AS (SELECT DISTINCT url, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path, TIMESTAMP '2024-02-29 21:00:00' + (page_id % 700) * INTERVAL '1' HOUR AS asked_at FROM pages),
o AS (SELECT DISTINCT origin FROM p), s AS (SELECT origin, n, TIMESTAMP '2024-03-01' + n * INTERVAL '6' HOUR AS fetched_at, [200, 503, 200, 404, 500, 200, 403, 429, 410, 401, 200][(n * 7 + length(origin)) % 11 + 1] AS status FROM o, (SELECT unnest(range({SHOTS})) AS n) WHERE n % 13 < 9),
a AS (SELECT p.*, s.n, s.status, s.fetched_at FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE status IN (200, 401, 403, 404, 410)) s ON p.origin = s.origin AND p.asked_at >= s.fetched_at)
SELECT url, asked_at, coalesce(status IN (404, 410) OR (status = 200 AND CASE WHEN starts_with(path, '/fr/1') THEN n % 2 = 0 WHEN starts_with(path, '/fr/') THEN FALSE WHEN starts_with(path, '/en/') THEN n % 3 > 0 ELSE TRUE END), FALSE) AS allowed,
 coalesce(fetched_at < asked_at - INTERVAL '24' HOUR, FALSE) AS stale FROM a""")
def admitted_urls(spark, sf_dir):
    """Page URLs at different times under up to a hundred robots snapshots of their origins, some of them failed requests."""
    at = F.lit("2024-02-29 21:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") % 700).cast("int"))
    p = table(spark, sf_dir, "pages").select("url", at.alias("at"))
    origins = p.select(F.regexp_extract("url", "^([^:]+://[^/?#]+)", 1).alias("origin")).distinct()
    n = F.col("n")
    rule = lambda i, allow, prefix: F.struct(F.lit(i).alias("rule_no"), allow.alias("allow"), F.lit(prefix).alias("prefix"))
    statuses = F.array(*[F.lit(x) for x in (200, 503, 200, 404, 500, 200, 403, 429, 410, 401, 200)])
    shots = origins.select("origin", F.explode(F.sequence(F.lit(0), F.lit(SHOTS - 1))).alias("n")).where("n % 13 < 9").select(
        "origin", (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(hours=n * 6)).alias("fetched_at"), F.get(statuses, (n * 7 + F.length("origin")) % 11).alias("status"),
        F.array(rule(3, n % 3 > 0, "/en/"), rule(2, F.lit(False), "/fr/"), rule(1, n % 2 == 0, "/fr/1")).alias("rules"),
    )
    return envelopes.url_admission(p, shots).select("url", F.col("at").cast("timestamp_ntz").alias("asked_at"), "allowed", "stale")


@query("""SELECT 'lever' AS source_type, 'b' || s_suppkey AS external_key, CASE WHEN s_suppkey % 3 > 0 THEN 0 ELSE 1 END AS consecutive_failures, s_suppkey % 3 > 0 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN 'unexpected hostedUrl: https://else/' || s_suppkey END AS disabled_reason FROM supplier WHERE s_suppkey % 4 > 0
 UNION ALL SELECT 'lever', 'b' || s_suppkey, 7, FALSE, 'known' FROM supplier WHERE s_suppkey % 4 = 0""")
def added_boards(spark, sf_dir):
    """Boards asked for: known ones stay as they are, others are checked by their postings' urls and saved."""
    s = table(spark, sf_dir, "supplier").withColumn("key", F.concat(F.lit("b"), "s_suppkey"))
    none = F.lit(None).cast("string")
    known = s.where("s_suppkey % 4 = 0").select(
        F.lit("lever").alias("source_type"), F.col("key").alias("external_key"), F.col("s_name").alias("name"), F.col("s_name").alias("company_name"), none.alias("base_url"), F.lit(60).alias("crawl_interval_minutes"),
        F.lit(False).alias("enabled"), F.lit(None).cast("timestamp").alias("next_crawl_at"), F.lit(7).alias("consecutive_failures"), F.lit("known").alias("disabled_reason"),
    )
    asked = s.select(F.lit("lever").alias("source_type"), F.col("key").alias("external_key"), F.col("s_name").alias("company_name"))
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://else/"), "s_suppkey")).otherwise(F.concat(F.lit("https://jobs.lever.co/"), "key", F.lit("/1")))
    posted = s.select(F.lit("lever").alias("source_type"), F.col("key").alias("source_external_key"), url.alias("source_url"), none.alias("payload_company"))
    out = raw.add_boards(asked, known, posted, "2024-03-02")
    return out.select("source_type", "external_key", "consecutive_failures", "enabled", "disabled_reason")


@query(f"SELECT doc_id, lower(city) IN ({', '.join(repr(c) for c in fixed.CITIES)}) AS known_city FROM facts_v", "facts_v")
def known_places(spark, sf_dir):
    cities = raw.load_geo_dims(spark)["cities"]
    f = view(spark, sf_dir, "facts_v").select("doc_id", F.lower("city").alias("city"))
    return f.join(cities.withColumn("hit", F.lit(True)), "city", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("known_city"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 OR c_nationkey = 1 THEN 'india' WHEN c_nationkey % 5 = 0 THEN 'remote_india' ELSE 'unknown' END AS relevance FROM customer")
def dimension_places(spark, sf_dir):
    """Customers' nations as places under dimension files that name every other nation as a city, and one of the others by an older name."""
    n = table(spark, sf_dir, "nation")
    path = f"{shared_dir(spark)}/dims-{uuid.uuid4().hex}"
    cities = n.where("n_nationkey % 2 = 0").agg(F.collect_list(F.concat(F.lit(" "), "n_name")).alias("cities"))  # a row a nation
    cities.withColumns({"states": F.array(F.lit("Kerala")), "aliases": F.create_map(F.lit("Nation_1"), F.lit("nation_2"))}).write.json(path)
    known = raw.places(raw.load_geo_dims(spark, path))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text_ = F.when(F.col("c_nationkey") % 5 == 0, "remote, anywhere in india")
    return rows.select("c_custkey", geo.classify_relevance(F.array("n_name"), "c_mktsegment", text_, places=known).alias("relevance"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def stored_table(spark, sf_dir):
    """A table through its writer, parted by a column, and its reader."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    raw.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ("c_mktsegment",))
    return raw.read_table(spark, path).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_acctbal, c_custkey % 3 AS batch_id FROM customer")
def jdbc_table(spark, sf_dir):
    """Customers in three batches into a database table, one of them twice, and back in eight ranges of the key."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tempfile.gettempdir()}/derby.log")
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    raw.run_sql(spark, url, 'CREATE TABLE customers ("c_custkey" BIGINT, "c_name" VARCHAR(100), "c_acctbal" DOUBLE, "batch_id" BIGINT)')
    for batch in (0, 1, 2, 1):
        raw.write_jdbc(rows.where(F.col("c_custkey") % 3 == batch), url, "customers", batch)
    return raw.read_jdbc(spark, url, "customers", '"c_custkey"', 8)


def _keyed(spark, rows: DataFrame, *key: str) -> str:
    name = f"keyed_{uuid.uuid4().hex}"
    keyed.create_keyed(rows, name, f"{shared_dir(spark)}/{name}", key, buckets=16)
    return name


@query("""WITH h AS (SELECT event_id AS id, user_id AS source_id, sha256(event_type) AS payload_hash FROM events WHERE event_id % 3 = 0 AND user_id % 5 > 0), b AS (SELECT event_id AS id, user_id AS source_id, sha256(event_type) AS payload_hash FROM events WHERE event_id % 3 > 0)
SELECT * FROM h UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source_id = b.source_id AND h.payload_hash = b.payload_hash)""")
def keyed_append(spark, sf_dir):
    """A bucketed history to which a batch adds the rows whose keys it does not have."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.sha2("event_type", 256).alias("payload_hash"))
    name = _keyed(spark, e.where("id % 3 = 0 and source_id % 5 > 0"), "source_id", "payload_hash")
    keyed.append_keyed(spark, name, written(keyed.new_rows(spark, name, e.where("id % 3 > 0")), "keyed-new"))
    return spark.table(name).drop(keyed.BUCKET)


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS title, o_orderkey % 4 AS sid, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS rank, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 0),
c AS (SELECT o_orderkey AS job_id, 'new' || o_custkey AS title, o_orderkey % 3 AS sid, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 3 END AS rank FROM orders WHERE o_orderkey % 13 < 2)
SELECT coalesce(j.job_id, c.job_id) AS job_id, CASE WHEN c.job_id IS NOT NULL AND (j.job_id IS NULL OR j.sid = c.sid OR c.rank < j.rank) THEN c.title ELSE j.title END AS title, CASE WHEN c.job_id IS NULL THEN 'expired' ELSE 'active' END AS status,
 coalesce(j.at, TIMESTAMP '2024-01-02') AS first_seen_at, CASE WHEN c.job_id IS NULL THEN j.at ELSE TIMESTAMP '2024-01-02' END AS last_seen_at FROM j FULL JOIN c ON j.job_id = c.job_id""")
def keyed_upsert(spark, sf_dir):
    """A bucketed snapshot of jobs into which a batch is merged twice, the second time without effect."""
    name = _keyed(spark, _jobs_snapshot(spark, sf_dir), "job_id")
    changes = table(spark, sf_dir, "orders").where("o_orderkey % 13 < 2").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("new"), "o_custkey").alias("title"), (F.col("o_orderkey") % 3).alias("source_id"), F.when(F.col("o_orderkey") % 3 == 1, "lever").otherwise("generic").alias("source_type"), F.lit(NOW).cast("timestamp_ntz").alias("seen_at")
    )
    for _ in range(2):
        keyed.merge_keyed(spark, name, changes, lambda old, new: resolve.upsert_job(old, new, ("title",)))
    return spark.table(name).select("job_id", "title", "status", "first_seen_at", "last_seen_at")


# --- normalised rows and publishing ----------------------------------------------------------------------------------


TITLE = "trim(regexp_replace(left(text, 40), '[^A-Za-z ]', '', 'g'))"
KIND = "['greenhouse', 'lever', 'ashby', 'workable'][doc_id % 4 + 1]"


def _normalised(spark, sf_dir):
    e = _all_envelopes(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.lit(k) for k in ("greenhouse", "lever", "ashby", "workable")])).alias("source_type"), F.col("source").alias("source_external_key"), F.col("source").alias("company_name")).distinct()
    return e, sources


@query(f"SELECT source_type, source_job_id, apply_url FROM (SELECT {KIND} AS source_type, CASE WHEN doc_id % 4 = 3 THEN 'S' ELSE '' END || doc_id AS source_job_id, 'https://' || ['b', 'l', 'a', 'w'][doc_id % 4 + 1] || '/' || doc_id AS apply_url FROM documents WHERE {TITLE} <> '')")
def candidate_rows(spark, sf_dir):
    """Normalised rows under the contract of candidates: exactly its columns and types."""
    good, _ = normalize.normalize_with_quarantine(*_normalised(spark, sf_dir))
    return assert_contract(good.drop("fetched_at"), CANDIDATE).select("source_type", "source_job_id", "apply_url")


@query(f"SELECT {KIND} AS source_type, source AS source_external_key, CASE WHEN doc_id % 4 = 3 THEN 'S' ELSE '' END || doc_id AS source_job_id, 'error' AS processing_status, CASE WHEN doc_id % 4 = 1 THEN 'missing text' ELSE 'missing title' END AS processing_error FROM documents WHERE {TITLE} = '' OR text IS NULL OR doc_id % 5 = 0")
def quarantined(spark, sf_dir):
    """Rows that cannot be normalised; every fifth posting has lost its title."""
    e, sources = _normalised(spark, sf_dir)
    n = F.regexp_extract("source_job_id", "[0-9]+", 0).cast("long")
    e = e.withColumn("payload", F.when(n % 5 == 0, F.parse_json(F.lit('{"company_name": "x"}'))).otherwise(F.col("payload")))
    _, bad = normalize.normalize_with_quarantine(e, sources)
    return bad


@query(CLASSIFIED + "SELECT candidate_id, 'rejected' AS processing_status, 'not_india' AS processing_error FROM r WHERE relevance = 'not_india'", "candidates_v")
def rejected_rows(spark, sf_dir):
    v = view(spark, sf_dir, "candidates_v")
    _, away = resolve.reject_not_relevant(v.select("candidate_id", geo.classify_relevance(F.array("location"), "title", "description").alias("relevance")))
    return away.select("candidate_id", "processing_status", "processing_error")


@query(CLASSIFIED + "SELECT candidate_id, relevance IN ('india', 'remote_india') AS publishable FROM r", "candidates_v")
def publishable(spark, sf_dir):
    v = view(spark, sf_dir, "candidates_v")
    return v.select("candidate_id", geo.is_publishable(geo.classify_relevance(F.array("location"), "title", "description")).alias("publishable"))


@query("""WITH o AS (SELECT l_orderkey AS job_id, CAST(l_suppkey % 9 AS VARCHAR) AS source_id, l_orderkey || '-' || l_linenumber AS sj, l_shipdate AS at, l_linenumber FROM lineitem), l AS (SELECT * FROM o WHERE l_linenumber % 3 < 2), s AS (SELECT DISTINCT job_id, source_id, sj FROM o WHERE l_linenumber % 3 > 0)
SELECT coalesce(l.job_id, s.job_id) AS job_id, coalesce(l.source_id, s.source_id) AS source_id, coalesce(l.sj, s.sj) AS source_job_id, CASE WHEN s.job_id IS NULL THEN 'old' ELSE 'new' END AS source_url, coalesce(l.at, TIMESTAMP '2024-01-02') AS first_seen_at,
 CASE WHEN s.job_id IS NULL THEN l.at ELSE TIMESTAMP '2024-01-02' END AS last_seen_at, CASE WHEN s.job_id IS NULL THEN 1 ELSE 0 END AS missing_count, s.job_id IS NOT NULL AS active FROM l FULL JOIN s ON l.job_id = s.job_id AND l.source_id = s.source_id AND l.sj = s.sj""")
def attached_links(spark, sf_dir):
    """Links of order lines: some known, some seen, some both."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 9).cast("string").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_job_id"), F.col("l_shipdate").alias("at"), "l_linenumber")
    known = li.where("l_linenumber % 3 < 2").select("job_id", "source_id", "source_job_id", F.lit("old").alias("source_url"), F.lit("r").alias("raw_job_id"), F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.lit(1).alias("missing_count"), F.lit(False).alias("active"))
    seen = li.where("l_linenumber % 3 > 0").select("job_id", "source_id", "source_job_id", F.lit("new").alias("source_url"), F.lit("s").alias("raw_job_id"), F.lit("2024-01-02").cast("timestamp_ntz").alias("seen_at"))
    return resolve.attach_source(known, seen).drop("raw_job_id")


def _titled(spark, sf_dir):
    """Postings of parts whose titles and texts are hashes, so that none is near another."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("greenhouse").alias("source_type"), F.col("p_brand").alias("source_external_key"), F.col("p_partkey").cast("string").alias("source_job_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("digest"), "p_partkey", "p_size",
        F.when(F.col("p_size") % 4 == 0, "London, United Kingdom").otherwise("Pune").alias("place"),
    )


@query("SELECT CASE WHEN p_size % 4 = 0 THEN 'rejected' ELSE 'created' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def published_tallies(spark, sf_dir):
    """The newest raw row of each posting, normalised and published from empty tables."""
    p = _titled(spark, sf_dir)
    job = F.struct("digest", F.col("digest").alias("title"), F.col("source_external_key").alias("company_name"), F.col("digest").alias("content"), F.struct(F.col("place").alias("name")).alias("location"))
    rows = p.select("*", F.parse_json(F.to_json(job)).alias("payload"), F.concat(F.lit("https://b/"), "p_partkey").alias("source_url"), F.concat_ws("/", "source_type", "source_external_key").alias("source_id"))
    old = rows.select("*", F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), (F.col("p_partkey") * 2).alias("id")).withColumn("payload", F.parse_json(F.lit('{"title": ""}')))
    new = rows.select("*", F.lit("2024-01-02").cast("timestamp").alias("fetched_at"), (F.col("p_partkey") * 2 + 1).alias("id"))
    out = publish_latest_raw(old.unionByName(new), None, spark.sql(_empty(JOBS)), spark.sql(_empty(LINKS)))
    return out["tallies"]


def _empty(ddl: str) -> str:
    return "SELECT " + ", ".join("CAST(NULL AS {1}) AS {0}".format(*f.split()) for f in ddl.split(", ")) + " WHERE false"


# --- serving -----------------------------------------------------------------------------------------------------------


def _served(spark, sf_dir):
    none = F.lit(None).cast("string")
    return view(spark, sf_dir, "jobs_v").withColumns({"country": F.col("country_code"), "employment_type": none, "apply_url": F.concat(F.lit("https://x/"), "id"), "first_seen_at": F.col("posted_at"), "last_seen_at": F.col("posted_at")})


SUMMARY = "id, title, company, city, state, country_code AS country, work_mode, CAST(NULL AS VARCHAR) AS employment_type, relevance, posted_at, 'https://x/' || id AS apply_url"


@query(f"SELECT {SUMMARY} FROM jobs_v WHERE {PUB}", "jobs_v")
def job_summary_rows(spark, sf_dir):
    return serve.job_summary(serve.published(_served(spark, sf_dir)))


@query(f"SELECT {SUMMARY}, description, posted_at AS first_seen_at, posted_at AS last_seen_at FROM jobs_v WHERE {PUB} AND id = (SELECT min(id) FROM jobs_v WHERE {PUB})", "jobs_v")
def job_details(spark, sf_dir):
    """The published job of the least id, by its id."""
    jobs = serve.published(_served(spark, sf_dir))
    return serve.job_detail(jobs.orderBy("id").limit(1))


# --- structuring and enrichment -------------------------------------------------------------------------------------------


POSTED = "(SELECT doc_id, posting, lower(posting) AS low, split_part(posting, ' ', 1) AS w1, split_part(posting, ' ', 2) AS w2 FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS posting FROM documents))"


@query(f"""SELECT doc_id, CASE WHEN contains(low, 'hybrid') THEN 'hybrid' WHEN contains(low, 'remote') OR contains(low, 'work from home') THEN 'remote' WHEN contains(low, 'onsite') OR contains(low, 'on site') OR contains(low, 'in office') THEN 'onsite' END AS mode,
 CASE WHEN doc_id % 5 < 4 AND (contains(low, 'contract') OR contains(low, 'freelance')) THEN 'contract' END AS employment,
 CASE WHEN doc_id % 5 < 4 THEN trim(w2 || ' zzzz') END AS leftover, CASE WHEN doc_id % 5 < 4 THEN [trim(w2 || ' & co')] END AS requirements FROM {POSTED}""")
def grounded_modes(spark, sf_dir):
    v = _responses(spark, sf_dir).withColumn("f", facts.coerce_facts("response"))
    none = F.lit(None).cast("string")
    return v.select(
        "doc_id", facts.ground_mode("f.work_mode", none, "posting", none, F.lit("unknown")).alias("mode"), facts.ground_employment("f.employment_type", none, "posting").alias("employment"),
        F.trim(facts.leftover_text("f.description_text", "f.requirements")).alias("leftover"), facts.lines("f.requirements").alias("requirements"),
    )


def _jobs(spark, sf_dir) -> DataFrame:
    """Jobs to structure: postings of parts, with the columns that structuring writes back."""
    v = view(spark, sf_dir, "postings_v")
    none = F.lit(None).cast("string")
    return v.select(
        F.col("candidate_id").alias("job_id"), F.col("title").alias("title_original"), "company_name", text.normalize_company("company_name").alias("company_normalized"), F.concat("description", F.lit(". Pay is 15-20 LPA.")).alias("description_text"), none.alias("description_html"),
        F.lit("Pune").alias("city"), none.alias("state"), none.alias("work_mode"), F.lit("Full-time").alias("employment_type"), F.lit("unknown").alias("india_relevance"), F.when(F.col("candidate_id") % 9 > 0, F.concat(F.lit("https://x/"), "candidate_id")).otherwise(F.concat(F.lit("ftp://x/"), "candidate_id")).alias("canonical_apply_url"),
        F.lit("2024-01-02").cast("timestamp").alias("posted_at"), none.alias("structure_status"), none.alias("structure_hash"), F.concat(F.lit("fp"), "candidate_id").alias("exact_fingerprint"), "source_type", "source_job_id",
        F.array().cast("array<string>").alias("skills"), *[F.lit(None).cast(t).alias(c) for c, t in (("salary_min", "decimal(18,2)"), ("salary_max", "decimal(18,2)"), ("salary_currency", "string"), ("salary_period", "string"))],
        F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit("2024-01-02").cast("timestamp").alias("checked_at"),
    )


def _structured(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    jobs = _jobs(spark, sf_dir)
    digest = text.structure_hash("title_original", structure.posting_text("description_text", "description_html"), "city", "canonical_apply_url")
    answer = F.when(F.col("job_id") % 5 == 1, "no json").otherwise('{"summary": "S", "skills": ["travel", "Quantum Basketry"], "experience_min_years": 3, "description_text": "nothing of that"}')
    answers = jobs.where("job_id % 5 > 0").repartition("job_id").select(text.cache_key(structure.TASK_STRUCTURE, fixed.STRUCTURE_VERSION, digest).alias("cache_key"), answer.alias("response"))
    return jobs, structure.structure_postings(jobs.drop("salary_min", "salary_max", "salary_currency", "salary_period"), answers)


OUTCOME = "CASE WHEN candidate_id % 9 = 0 THEN 'failed' WHEN candidate_id % 5 = 0 THEN 'pending' WHEN candidate_id % 5 = 1 THEN 'failed' ELSE 'ready' END"
SKILLS = "CASE WHEN candidate_id % 5 > 1 THEN CASE WHEN contains(description, 'travel') THEN ['travel'] ELSE CAST([] AS VARCHAR[]) END END"


@query(f"""SELECT candidate_id AS job_id, {OUTCOME} AS outcome, 'full_time' AS employment_type, 'Maharashtra' AS state, {SKILLS} AS skills, CAST(1500000 AS DOUBLE) AS low, CAST(2000000 AS DOUBLE) AS high,
 CASE WHEN {OUTCOME} = 'ready' THEN 'fp' || candidate_id || '|S|IN|nothing of that|2024-01-02T00:00:00Z|year' END AS payload FROM postings_v""", "postings_v")
def structured_postings(spark, sf_dir):
    """Postings with answers for most of them, through the whole structuring chain."""
    _, out = _structured(spark, sf_dir)
    p = F.col("payload")
    sent = F.concat_ws("|", p["external_key"], p["summary"], p["country_code"], p["description_text"], p["posted_at"], p["salary_period"])
    return out.select("job_id", "outcome", "employment_type", "state", "skills", F.col("salary.salary_min").cast("double").alias("low"), F.col("salary.salary_max").cast("double").alias("high"), F.when(p.isNotNull(), sent).alias("payload"))


@query(f"SELECT candidate_id AS job_id, CASE WHEN {OUTCOME} = 'ready' THEN 'ready' END AS structure_status, CASE WHEN {OUTCOME} = 'ready' THEN 'Maharashtra' END AS state, CASE WHEN {OUTCOME} = 'ready' THEN CAST(2000000 AS DOUBLE) END AS high, CASE WHEN {OUTCOME} = 'ready' THEN {SKILLS} ELSE CAST([] AS VARCHAR[]) END AS skills FROM postings_v", "postings_v")
def applied_facts(spark, sf_dir):
    jobs, out = _structured(spark, sf_dir)
    return structure.apply_structured(jobs, out).select("job_id", "structure_status", "state", F.col("salary_max").cast("double").alias("high"), "skills")


@query(f"""SELECT candidate_id AS job_id, n AS step_no, ['fetched', 'normalized', 'model', 'checked', 'saved'][n] AS step, CASE n WHEN 1 THEN '2024-01-01T00:00:00Z' ELSE '2024-01-02T00:00:00Z' END AS at, CASE n WHEN 5 THEN {OUTCOME} END AS saved FROM postings_v, (SELECT unnest([1, 2, 3, 4, 5]) AS n)""", "postings_v")
def traced_steps(spark, sf_dir):
    _, out = _structured(spark, sf_dir)
    return structure.pipeline_trace(out).select("job_id", "step_no", "step", "at", F.when(F.col("step_no") == 5, F.col("detail")).alias("saved"))


def _to_enrich(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("relevance", F.when(F.col("event_id") % 3 == 0, "unknown").when(F.col("event_id") % 3 == 1, "unknown_remote").otherwise("india"))
    none = F.lit(None)
    jobs = e.select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("Title "), "event_id").alias("title_original"), F.lit("old").alias("title_normalized"), none.cast("string").alias("city"), none.cast("string").alias("state"), F.col("props").alias("description_text"),
        F.array().cast("array<string>").alias("skills"), none.cast("double").alias("experience_min"), none.cast("double").alias("experience_max"), none.cast("string").alias("work_mode"), F.col("relevance").alias("india_relevance"),
        (F.col("event_id") % 7 == 0).alias("ai_enriched"), F.col("ts").cast("timestamp").alias("last_checked_at"),
    )
    key = text.cache_key(structure.TASK_ENRICH, "v1", text.normalized_input_text("title_original", F.lit(""), "description_text"))
    body = '{"normalized_title": "New", "role_category": null, "seniority": null, "skills": ["a"], "experience_min": 1, "experience_max": %s, "work_mode": "remote", "india_eligibility": "remote_india"}'
    answers = jobs.where("job_id % 2 = 0").select(key.alias("cache_key"), F.when(F.col("job_id") % 10 == 0, body % "0").otherwise(body % "5").alias("response"))
    return jobs, answers


ASKED = "(event_id % 3 < 2 AND event_id % 7 > 0)"
ANSWERED = f"({ASKED} AND event_id % 2 = 0 AND event_id % 10 > 0)"


@query(f"""SELECT event_id AS job_id, CASE WHEN {ANSWERED} THEN 'New' ELSE 'old' END AS title_normalized, CASE WHEN {ANSWERED} THEN 'remote_india' WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'unknown_remote' ELSE 'india' END AS india_relevance,
 event_id % 7 = 0 OR {ANSWERED} AS ai_enriched, CASE WHEN {ANSWERED} THEN CAST(5 AS DOUBLE) END AS experience_max FROM events""")
def enriched_jobs(spark, sf_dir):
    jobs, answers = _to_enrich(spark, sf_dir)
    done, _ = structure.enrich_jobs(jobs, answers, budget=3)
    return done.select("job_id", "title_normalized", "india_relevance", "ai_enriched", "experience_max")


@query(f"SELECT day, least(count(*), 3) AS admitted FROM (SELECT CAST(ts AS DATE) AS day FROM events WHERE {ASKED} AND event_id % 2 = 1) GROUP BY 1")
def enrichment_requests(spark, sf_dir):
    """Requests that a budget of three a day admits; answers that are stored cost nothing."""
    _, asked = structure.enrich_jobs(*_to_enrich(spark, sf_dir), budget=3)
    return asked.groupBy("day").agg(F.count("*").alias("admitted"))


@query(f"SELECT page_id, {SPACED.format('regexp_replace(' + DECODED.format('html') + ', ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS html, [url] AS urls, page_id AS n FROM pages")
def scrubbed_rows(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.array(F.concat(F.lit(" <b>"), "url"), F.lit("<br> "), F.lit("")).alias("urls"), F.col("page_id").alias("n"))
    return p.select("page_id", *[c.alias(n) for n, c in facts.scrubbed({"html": "", "urls": "", "n": ""}, p.schema).items()])


# --- streams --------------------------------------------------------------------------------------------------------------


def _in_runs(spark, rows: DataFrame, start, *parts: str) -> None:
    """``rows`` as files that arrive part by part (conditions): after each part the stream runs on from its checkpoint until it has all."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        rows.where(part).write.parquet(f"{path}/{i}")
        start(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)).awaitTermination()


@query("""SELECT DISTINCT user_id % 50 AS source_id, CAST(event_id % 40 AS VARCHAR) AS source_job_id, sha256('{"k":' || regexp_extract(props, '[0-9]+') || '}') AS payload_hash FROM events""")
def landed_stream(spark, sf_dir):
    """Envelopes as a stream, repeats dropped by the stream's own state."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source_id"), (F.col("event_id") % 40).cast("string").alias("source_job_id"), F.col("ts").cast("timestamp").alias("fetched_at"), "props")
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"

    def start(arrived):
        rows = stream.raw_landing(arrived.withColumn("payload", F.parse_json("props"))).select("source_id", "source_job_id", "payload_hash")
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)

    _in_runs(spark, e, start, "source_id < 20", "source_id >= 15 or source_id is null")
    return spark.read.schema("source_id long, source_job_id string, payload_hash string").parquet(path)


BOARDS = "SELECT k AS source_type, source AS source_external_key, CASE WHEN k = 'workable' THEN 'S' ELSE '' END || doc_id AS source_job_id, 'https://' || CASE k WHEN 'greenhouse' THEN 'b' ELSE k[1] END || '/' || doc_id AS source_url FROM (SELECT *, ['greenhouse', 'lever', 'ashby', 'workable'][doc_id % 4 + 1] AS k FROM documents)"


def _landed(spark, sf_dir, *landings: str) -> str:
    """Board responses landed one landing after the other (conditions), as a path."""
    landing.register(spark)
    path = f"{shared_dir(spark)}/boards-{uuid.uuid4().hex}"
    for i, part in enumerate(landings):
        landing.land(_envelopes(spark, sf_dir).where(part), path, i)
    return path


@query(BOARDS)
def board_source(spark, sf_dir):
    """Landed board responses read by their own format."""
    path = _landed(spark, sf_dir, "source_type in ('lever', 'ashby')", "source_type not in ('lever', 'ashby')")
    rows = envelopes.envelopes_boards(spark.read.format(landing.NAME).load(path))
    return rows.select("source_type", "source_external_key", "source_job_id", "source_url")


@query(BOARDS)
def board_stream(spark, sf_dir):
    """Landed board responses as a stream that is stopped between two landings and goes on behind its offset."""
    parts = ["source_type in ('lever', 'ashby')", "source_type not in ('lever', 'ashby')"]
    path = _landed(spark, sf_dir)
    for i, part in enumerate(parts):
        landing.land(_envelopes(spark, sf_dir).where(part), path, i)
        rows = envelopes.envelopes_boards(spark.readStream.format(landing.NAME).load(path)).select("source_type", "source_external_key", "source_job_id", "source_url")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-out").awaitTermination()
    return spark.read.schema("source_type string, source_external_key string, source_job_id string, source_url string").parquet(f"{path}-out")


@query("SELECT p_brand AS company_name, sha256(CAST(p_partkey AS VARCHAR)) AS title, 'active' AS status, p_size % 2 AS seen_again FROM part WHERE p_size % 4 > 0")
def published_stream(spark, sf_dir):
    """Two micro-batches of candidates through publishing; the second brings half of the first again. Places abroad are rejected."""
    p = _titled(spark, sf_dir)
    none = F.lit(None).cast("string")
    rows = p.select(
        F.col("digest").alias("title_original"), F.col("source_external_key").alias("company_name"), F.col("digest").alias("description_text"), F.array("place").alias("locations_raw"), F.concat(F.lit("https://b/"), "p_partkey").alias("apply_url"),
        none.alias("employment_type"), "source_job_id", "source_type", "source_external_key", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("batch"),
    ).withColumn("fetched_at", F.when(F.col("batch") == 0, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2024-01-02").cast("timestamp"))).where("batch = 0 or p_size % 2 = 1")
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    at: dict[str, str] = {}

    def load():
        return (raw.read_table(spark, f"{at['last']}/jobs"), raw.read_table(spark, f"{at['last']}/links")) if at else (spark.sql(_empty(JOBS)), spark.sql(_empty(LINKS)))

    def save(jobs, links, batch_id):
        jobs.write.mode("overwrite").parquet(f"{path}/{batch_id}/jobs")
        links.write.mode("overwrite").parquet(f"{path}/{batch_id}/links")
        at["last"] = f"{path}/{batch_id}"

    _in_runs(spark, rows, lambda arrived: publish_stream(arrived, load, save, f"{path}-state"), "batch = 0", "batch = 1")
    jobs, _ = load()
    return jobs.select("company_name", "title", "status", (F.col("last_seen_at") > F.col("first_seen_at")).cast("int").alias("seen_again"))


@contextmanager
def _rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("""WITH c AS (SELECT DISTINCT l_suppkey % 20 AS source_id, l_linenumber AS seq, CAST(l_orderkey % 60 AS VARCHAR) AS job FROM lineitem WHERE l_linenumber IN (1, 3, 5, 6, 7)), n AS (SELECT DISTINCT source_id, seq FROM c),
j AS (SELECT source_id, job, max(seq) AS last FROM c GROUP BY 1, 2), m AS (SELECT j.source_id, j.job, least(2, count(n.seq)) AS misses FROM j LEFT JOIN n ON n.source_id = j.source_id AND n.seq > j.last GROUP BY 1, 2)
SELECT source_id, job AS source_job_id, CAST(misses AS INT) AS missing_count, misses < 2 AS active FROM m""")
def stateful_crawls(spark, sf_dir):
    """Crawls as a stream with state by part of a source: 1, 3 and 5 come first; 2 and 4 come late and change nothing; 6 and 7 count.
    Between the two runs the stream is stopped and goes on from its checkpoint."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("source_id"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_orderkey") % 60).cast("string").alias("source_job_id"))
    li = li.distinct().withColumn("at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("seq").cast("int")))
    rows = stream.crawl_rows(li, li.select("source_id", "seq", "at").distinct())
    path = f"{shared_dir(spark)}/crawls-{uuid.uuid4().hex}"

    def start(arrived):
        changed = stream.stateful_freshness(arrived)
        return changed.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/{i}")).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()

    with _rocks(spark):
        _in_runs(spark, rows, start, "seq in (1, 3, 5)", "seq in (2, 4, 6, 7)")
    every = spark.read.option("recursiveFileLookup", "true").schema(stream.FRESHNESS).parquet(path)
    newest = F.max_by(F.struct("missing_count", "active"), "seq").alias("x")
    return every.groupBy("source_id", "source_job_id").agg(newest).select("source_id", "source_job_id", "x.missing_count", "x.active")


@query("""WITH e AS (SELECT o_orderkey AS u, o_orderkey - (o_orderkey % 7 + 1) AS v FROM orders WHERE o_orderkey % 5 < 3 AND o_custkey % 9 > 0),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), w AS (WITH RECURSIVE r AS (SELECT u AS n, u AS l FROM b UNION SELECT b.v, r.l FROM r JOIN b ON b.u = r.n AND r.l < b.v) SELECT n, min(l) AS l FROM r GROUP BY 1)
SELECT n AS node, l AS component FROM w""")
def component_stream(spark, sf_dir):
    """Links between orders in four micro-batches; the components that are carried on are those of all links at once."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 < 3 and o_custkey % 9 > 0")
    links = o.select(F.col("o_orderkey").alias("u"), F.expr("o_orderkey - (o_orderkey % 7 + 1)").alias("v"), (F.col("o_custkey") % 4).alias("batch"))
    path = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    _in_runs(spark, links, lambda arrived: stream.components_stream(arrived, path, f"{path}-state"), *[f"batch = {i}" for i in range(4)])
    return stream.read_components(spark, path)


DELAY, WIDTH = "1 hour", "6 hours"


@query("""WITH e AS (SELECT ts, user_id % 10 AS source_id, event_type = 'error' AS failed, event_id, time_bucket(INTERVAL '6 hours', ts) AS w, CASE WHEN event_id % 10 = 0 THEN 3 WHEN ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 1 ELSE 2 END AS part FROM events),
t AS (SELECT (SELECT max(ts) FROM e WHERE part < 3) - INTERVAL '1 hour' AS late, (SELECT max(ts) FROM e) - INTERVAL '1 hour' AS done)
SELECT w AS window_start, source_id, count(*) AS runs, count(*) FILTER (failed) AS failed, count(*) AS fetched FROM e, t WHERE w + INTERVAL '6 hours' <= done AND (part < 3 OR w + INTERVAL '6 hours' > late) GROUP BY 1, 2""")
def late_crawl_totals(spark, sf_dir):
    """Windowed totals of a running stream in append mode: a window is put out when the watermark has passed its end, and what comes
    after that is left out. The first half of the events comes first, then the second, and every tenth event last, most of it late."""
    e = table(spark, sf_dir, "events")
    middle = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle"))
    part = F.when(F.col("event_id") % 10 == 0, 3).when(F.col("ts") < F.col("middle"), 1).otherwise(2)
    runs = e.join(F.broadcast(middle)).select(F.col("ts").cast("timestamp").alias("started_at"), (F.col("user_id") % 10).alias("source_id"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.lit(1).alias("fetched_count"), part.alias("part"))
    path = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"

    def start(arrived):
        totals = stream.windowed_crawl_totals(arrived, WIDTH, DELAY)
        return totals.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)

    _in_runs(spark, runs, start, "part = 1", "part = 2", "part = 3")
    out = spark.read.schema("window_start timestamp, source_id long, runs long, failed long, fetched long").parquet(path)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
