import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import clusters, freshness, resolve, serve, structure, sync
from tidewell.sources import detect, envelopes, normalize, raw
from tidewell.streaming import stream


def responses(spark, kind, payload, key="acme"):
    return spark.createDataFrame([(kind, key, json.dumps(payload))], "source_type string, source_external_key string, body string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp"))


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "source_type string, source_external_key string, company_name string")


def test_boards_to_candidates(spark):
    green = responses(spark, "greenhouse", {"jobs": [{"id": 1, "title": " Dev ", "company_name": "Acme", "absolute_url": "https://g/1", "content": "&lt;p&gt;Hi &amp;amp; you&lt;/p&gt;", "location": {"name": "Pune; ;Delhi "}, "updated_at": "2024-01-01T00:00:00Z"}, {"id": None}, 3, {"id": 2, "title": " "}]})
    lever = responses(spark, "lever", [{"id": "l1", "text": "Dev", "hostedUrl": "https://l/1", "categories": {"location": "Goa", "allLocations": ["Pune", "Pune"], "commitment": "Full"}, "createdAt": 1700000000000, "description": "<b>x</b>"}])
    ashby = responses(spark, "ashby", {"jobs": [{"id": "a1", "title": "Dev", "jobUrl": "https://a/1", "location": "Pune", "secondaryLocations": [{"location": "Goa"}, "Pune", 5], "publishedAt": "2024-02-01", "isListed": False}]})
    work = responses(spark, "workable", {"name": "Acme", "jobs": [{"shortcode": " ", "code": "C1", "title": "Dev", "shortlink": "https://w/1", "locations": [{"city": "Pune", "region": "MH", "country": "India"}, {"city": "Pune", "state": "MH", "country": "India"}]}, {"title": "no id"}]})
    rows = [f(r) for f, r in ((envelopes.envelopes_greenhouse, green), (envelopes.envelopes_lever, lever), (envelopes.envelopes_ashby, ashby), (envelopes.envelopes_workable, work))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    odd = every.limit(1).withColumn("source_type", F.lit("myspace"))
    known = sources(spark, ("lever", "acme", "Acme"), ("ashby", "acme", "Acme"), ("workable", "acme", None))
    good, bad = normalize.normalize_with_quarantine(every.unionByName(odd), known)
    got = {r["source_job_id"]: r for r in good.collect()}
    assert set(got) == {"1", "l1", "a1"}
    assert got["1"]["locations_raw"] == ["Pune", "Delhi"] and got["1"]["description_text"] == "Hi & you" and got["1"]["apply_url"] == "https://g/1"
    assert got["l1"]["locations_raw"] == ["Goa", "Pune", "Pune"] and got["l1"]["description_text"] == "x" and got["l1"]["posted_at"].year == 2023
    assert got["a1"]["locations_raw"] == ["Pune", "Goa"] and got["a1"]["employment_type"] is None
    assert {(r["source_job_id"], r["processing_error"]) for r in bad.collect()} == {("2", "missing title"), ("C1", "missing company_name"), ("1", "no connector")}
    place = normalize.normalize_workable(rows[3], sources(spark, ("workable", "acme", "Acme"))).first()
    assert place["locations_raw"] == ["Pune, MH, India"] and place["apply_url"] == "https://w/1"
    schemas.assert_contract(good.select(*schemas.CANDIDATE_COLUMNS), schemas.CANDIDATE)
    with pytest.raises(ValueError):
        schemas.assert_contract(good.withColumn("more", F.lit(1)), schemas.CANDIDATE)
    ok, held = envelopes.account_name_check(work, sources(spark, ("workable", "acme", "Other")))
    assert ok.count() == 0 and held.count() == 1


def test_json_ld_pages(spark):
    def page(i, *blocks):
        return (f"https://p/{i}", "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks))

    posting = {"@type": "JobPosting", "title": "Dev", "hiringOrganization": "Org", "jobLocation": {"address": {"addressLocality": "Pune", "addressCountry": "IN"}}, "applicantLocationRequirements": [{"name": "India"}, "Pune, IN"], "url": "https://j/1", "description": "plain", "validThrough": "2024-05-01"}
    rows = [page(1, json.dumps([{"x": {"y": [posting]}}]), "{bad"), page(2, json.dumps({"@type": ["Thing", "http://schema.org/JobPosting"], "title": "T", "identifier": " id "})), page(3, json.dumps({"@type": "Person"}))]
    df = spark.createDataFrame(rows, "url string, html string").withColumns({"source_external_key": F.lit("k"), "fetched_at": F.lit(None).cast("timestamp")})
    env = envelopes.envelopes_jsonld(df)
    assert {r["source_job_id"] for r in env.collect()} == {"https://j/1", "id"}
    got = normalize.normalize_jsonld(env).where("error is null").first()
    assert got["company_name"] == "Org" and got["locations_raw"] == ["Pune, IN", "India"] and got["apply_url"] == "https://j/1" and got["description_html"] is None and got["expires_at"] is not None


def test_sitemaps_and_robots(spark):
    pages = spark.createDataFrame([("https://s/map.xml", "<sitemapindex><loc>https://s/m2.xml</loc></sitemapindex>", "text/xml"), ("https://s/m2.xml", "<urlset><url><loc> https://s/a&amp;b </loc></url><url><loc>https://s/gone</loc></url></urlset>", "text/xml"), ("https://s/a&b", "<p>", "text/html"), ("https://s/plain", "<p>", "text/html")], "url string, html string, content_type string")
    roots = spark.createDataFrame([("https://s/map.xml",), ("https://s/plain",)], "url string")
    assert {(r["root"], r["url"]) for r in envelopes.sitemap_expand(pages, roots).collect()} == {("https://s/map.xml", "https://s/a&b"), ("https://s/plain", "https://s/plain")}
    snaps = spark.createDataFrame([("https://a", "2024-01-01 00:00:00", 200, [(1, False, "/x"), (2, True, "/")]), ("https://a", "2024-01-02 00:00:00", 404, []), ("https://b", "2024-01-01 00:00:00", 403, []), ("https://c", "2024-01-01 00:00:00", 200, [(1, False, "/x"), (2, True, "/x/y")])], "origin string, f string, status int, rules array<struct<rule_no:int,allow:boolean,prefix:string>>").withColumn("fetched_at", F.col("f").cast("timestamp")).drop("f")
    urls = spark.createDataFrame([("https://a/x", "2024-01-01 12:00:00"), ("https://a/x", "2024-01-03 12:00:00"), ("https://b/", "2024-01-01 01:00:00"), ("https://c/x/y", "2024-01-01 01:00:00"), ("https://c/q", "2024-01-01 01:00:00"), ("https://d/q", "2024-01-01 01:00:00")], "url string, a string").withColumn("at", F.col("a").cast("timestamp")).drop("a")
    got = {(r["url"], r["at"].day): (r["allowed"], r["stale"]) for r in envelopes.url_admission(urls, snaps).collect()}
    assert [got[k][0] for k in (("https://a/x", 1), ("https://a/x", 3), ("https://b/", 1), ("https://c/x/y", 1), ("https://c/q", 1), ("https://d/q", 1))] == [False, True, False, False, True, False]
    assert got["https://a/x", 3][1] is True


def test_detection(spark):
    rows = [(1, "https://boards.greenhouse.io/acme/jobs/1", ""), (2, "https://x.dev", 'see https://jobs.lever.co/a and https://jobs.lever.co/b'), (3, "https://boards-api.greenhouse.io/v1/boards/zed/jobs", None), (4, "https://www.workable.com/acme", ""), (5, "https://jobs.lever.co/", ""), (6, "https://x.dev", '<script type="application/ld+json">{"@type":"JobPosting"}</script>'), (7, None, None)]
    got = {r["page_id"]: (r["status"], r["source_type"], r["external_key"]) for r in detect.detect(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: ("detected", "greenhouse", "acme"), 2: ("needs-review", None, None), 3: ("detected", "greenhouse", "zed"), 4: ("detected", "workable", "acme"), 5: ("detected", "lever", None), 6: ("detected", "generic-jsonld", None), 7: ("needs-review", None, None)}
    boards = spark.createDataFrame([("https://jobs.ashbyhq.com/x", ""), ("key", "Lever"), ("bad key", "lever"), ("key", "adzuna"), ("https://x.dev", "")], "b string, t string")
    assert [tuple(r["p"]) for r in boards.select(detect.parse_board("b", "t").alias("p")).collect()] == [("ashby", "x"), ("lever", "key"), (None, None), (None, None), (None, None)]


def test_raw_history_keeps_the_first(spark):
    rows = [(1, "s", "j", '{"a":1,"b":2}', "2024-01-01"), (2, "s", "j", '{"b":2,"a":1}', "2024-01-02"), (3, "s", "j", '{"a":2}', "2024-01-03")]
    e = raw.with_payload_hash(spark.createDataFrame(rows, "id int, source_id string, source_job_id string, p string, fetched_at string").withColumn("payload", F.parse_json("p")))
    new = raw.append_raw_if_new(e, e.limit(0))
    assert sorted(r["id"] for r in new.collect()) == [1, 3]
    assert raw.append_raw_if_new(e, new).count() == 0
    assert [r["id"] for r in raw.latest_raw(e).collect()] == [3]
    assert [r["id"] for r in raw.raw_ids_for_source(e, "s").collect()] == [1, 2, 3]
    assert raw.load_geo_dims(spark)["cities"].count() == 86


def test_boards_are_checked_before_they_are_saved(spark):
    ddl = "source_type string, external_key string, name string, company_name string, base_url string, enabled boolean, crawl_interval_minutes int, next_crawl_at timestamp, consecutive_failures int, disabled_reason string"
    old = spark.createDataFrame([("lever", "old", "O", "O", "u", True, None, None, 0, None)], ddl)
    asked = spark.createDataFrame([("lever", "old", "O"), ("lever", "good", "G"), ("lever", "bad", "B"), ("ashby", "none", "N"), ("greenhouse", "g", "Acme")], "source_type string, external_key string, company_name string")
    env = spark.createDataFrame([("lever", "good", "https://jobs.lever.co/good/1", None), ("lever", "bad", "https://jobs.lever.co/else/1", None), ("lever", "bad", None, None), ("greenhouse", "g", "x", "Other")], "source_type string, source_external_key string, source_url string, payload_company string")
    got = {r["external_key"]: r for r in raw.add_boards(asked, old, env, "2024-01-01 00:00:00").collect()}
    assert got["old"]["enabled"] and got["good"]["enabled"] and got["good"]["next_crawl_at"].hour == 6
    assert got["none"]["disabled_reason"] == "no jobs returned" and got["g"]["disabled_reason"] == "unexpected company name" and "hostedUrl" in got["bad"]["disabled_reason"] and not got["bad"]["enabled"]


def jobs_frame(spark, rows, key):
    ddl = f"{key} long, company_name string, title string, location string, requisition_id string, canonical_url string, description string, source_type string, source_id string, source_job_id string"
    return resolve.with_identity(spark.createDataFrame(rows, ddl))


def test_resolution_by_exact_and_near_keys(spark):
    body = "python spark data engineer builds large pipelines for analytics teams every day with care"
    jobs = jobs_frame(spark, [(1, "Acme Inc", "Data Engineer", "Pune", None, "https://e.com/1?utm_id=2", body, "lever", "s", "j1"), (2, "Acme", "Chef", "Delhi", "R9", None, None, "lever", "s", "j2"), (3, "Beta", "Senior Data Engineer II", "Pune, India", None, None, body, "ashby", "t", "j3")], "job_id")
    new = jobs_frame(spark, [
        (10, "ACME", "data engineer", "Pune", None, None, None, "adzuna", None, None), (11, "Other", "X", "Y", None, "https://E.com/1/#a", None, "adzuna", None, None), (12, "Acme Ltd", "Cook", "Goa", "r9", None, None, "adzuna", None, None),
        (13, "Z", "Z", "Z", None, None, None, "adzuna", "s", "j2"), (14, "Beta LLC", "Sr Data Engineer II", "Pune", None, None, body + " always", "adzuna", None, None), (15, "Beta", "Sr Data Engineer II", "Pune", None, None, "", "adzuna", None, None), (16, "Beta", "Sr Data Engineer II", "Goa", None, None, body, "adzuna", None, None),
    ], "candidate_id")
    got = {r["candidate_id"]: (r["job_id"], r["how"]) for r in resolve.find_duplicates(new, jobs).collect()}
    assert got == {10: (1, "exact"), 11: (1, "exact"), 12: (2, "exact"), 13: (2, "exact"), 14: (3, "fuzzy")}
    links = spark.createDataFrame([("s", "j2", 77)], "source_id string, source_job_id string, job_id long")
    how = {r["candidate_id"]: (r["job_id"], r["how"]) for r in resolve.resolve_identity(new, jobs, links).collect()}
    assert how[13] == (77, "link") and how[10] == (1, "fingerprint") and how[11] == (1, "url") and how[14] == (3, "fuzzy") and how[15] == (None, None)
    groups = resolve.clusters(new.unionByName(jobs.withColumnRenamed("job_id", "candidate_id")))
    label = {r["candidate_id"]: r["cluster"] for r in groups.collect()}
    assert label[1] == label[10] == label[11] and label[3] == label[14] == label[15] and label[16] != label[3]
    kept = resolve.collapse(new.withColumn("g", F.lit(1)).unionByName(jobs.withColumnRenamed("job_id", "candidate_id").withColumn("g", F.lit(1))), "g", "candidate_id")
    assert [r["candidate_id"] for r in kept.collect()] == [1]


def test_components_equal_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in clusters.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {n: find(n) for n in parent}
    assert clusters.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_upserts(spark):
    ddl = "job_id long, title string, canonical_source_id string, canonical_source_type string, first_seen_at string, last_seen_at string, status string"
    jobs = spark.createDataFrame([(1, "a", "s1", "adzuna", "t0", "t0", "expired"), (2, "b", "s2", "lever", "t0", "t0", "active"), (3, "c", "s3", "lever", "t0", "t0", "expired")], ddl)
    ch = spark.createDataFrame([(1, "A", "s9", "lever", "t1"), (2, "B", "s8", "adzuna", "t1"), (4, "D", "s1", "adzuna", "t1")], "job_id long, title string, source_id string, source_type string, seen_at string")
    once = resolve.upsert_job(jobs, ch, ("title",))
    got = {r["job_id"]: (r["title"], r["status"], r["first_seen_at"], r["last_seen_at"], r["canonical_source_id"]) for r in once.collect()}
    assert got == {1: ("A", "active", "t0", "t1", "s9"), 2: ("b", "active", "t0", "t1", "s2"), 3: ("c", "expired", "t0", "t0", "s3"), 4: ("D", "active", "t1", "t1", "s1")}
    assert sorted(map(tuple, resolve.upsert_job(once, ch, ("title",)).collect())) == sorted(map(tuple, once.collect()))
    links = spark.createDataFrame([(1, "s", "j", "u", 5, "t0", "t0", 2, False)], "job_id long, source_id string, source_job_id string, source_url string, raw_job_id long, first_seen_at string, last_seen_at string, missing_count int, active boolean")
    seen = spark.createDataFrame([(1, "s", "j", "v", 6, "t1"), (2, "s", "k", "w", 7, "t1")], "job_id long, source_id string, source_job_id string, source_url string, raw_job_id long, seen_at string")
    assert sorted(map(tuple, resolve.attach_source(links, seen).collect())) == [(1, "s", "j", "v", 6, "t0", "t1", 0, True), (2, "s", "k", "w", 7, "t1", "t1", 0, True)]


def test_freshness_history_equals_crawl_by_crawl(spark):
    r = random.Random(7)
    state, seen_rows = {}, []
    links = None
    ddl = "job_id long, source_id long, source_job_id string, missing_count int, active boolean"
    for seq in range(1, 6):
        seen = {f"j{r.randrange(6)}" for _ in range(3)}
        seen_rows += [(1, j, seq) for j in seen]
        links = spark.createDataFrame([(int(j[1:]), 1, j, m, a) for j, (m, a) in state.items()], ddl)
        new = freshness.apply_source_crawl(links, spark.createDataFrame([(1, j) for j in seen], "source_id long, source_job_id string"), spark.createDataFrame([(1,)], "source_id long"))
        state = {x["source_job_id"]: (x["missing_count"], x["active"]) for x in new.collect()}
        state |= {j: (0, True) for j in seen}
    crawls = spark.createDataFrame([(1, s) for s in range(1, 6)], "source_id long, seq long")
    got = freshness.crawl_history_state(crawls, spark.createDataFrame(seen_rows, "source_id long, source_job_id string, seq long"))
    assert {x["source_job_id"]: (x["missing_count"], x["active"]) for x in got.collect()} == state


def test_structuring_chain(spark):
    ddl = "job_id long, title_original string, company_name string, company_normalized string, description_text string, description_html string, city string, state string, work_mode string, employment_type string, india_relevance string, canonical_apply_url string, posted_at timestamp, structure_status string, structure_hash string, exact_fingerprint string"
    mk = lambda i, url="https://x", body="Work on-site with Python for 5 years. Pay 10-12 LPA": (i, "Dev", "Acme", "acme", body, None, "Pune", None, None, "Full-time", "india", url, None, None, None, f"fp{i}")
    jobs = spark.createDataFrame([mk(1), mk(2, "ftp://x"), mk(3, body="other"), mk(4, body="bad")], ddl)
    from tidewell.functions import fixed, text

    key = lambda i: jobs.where(f"job_id = {i}").select(text.cache_key(structure.TASK_STRUCTURE, fixed.STRUCTURE_VERSION, text.structure_hash("title_original", structure.posting_text("description_text", "description_html"), "city", "canonical_apply_url")).alias("cache_key"))
    answers = key(1).withColumn("response", F.lit('{"summary": "<b>S</b>", "skills": ["Python", "COBOL"], "work_mode": "remote", "experience_min_years": 5, "experience_label": "5 years", "description_text": "rest of it"}')).unionByName(key(4).withColumn("response", F.lit("nope")))
    out = structure.structure_postings(jobs, answers)
    got = {r["job_id"]: r for r in out.collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {1: "ready", 2: "failed", 3: "pending", 4: "failed"}
    p = got[1]["payload"]
    assert (p["skills"], p["work_mode"], p["state"], p["employment_type"], p["salary_min"], p["summary"], p["experience_min_years"]) == (["Python"], "onsite", "Maharashtra", "full_time", 1000000, "S", 5.0)
    assert got[1]["dropped"] == ["COBOL"]
    base = jobs.withColumns({"skills": F.array(F.lit("x")), "salary_min": F.lit(1).cast("long"), "salary_max": F.lit(None).cast("long"), "salary_currency": F.lit("INR"), "salary_period": F.lit("year")})
    done = {r["job_id"]: r for r in structure.apply_structured(base, out).collect()}
    assert done[1]["structure_status"] == "ready" and done[1]["skills"] == ["Python"] and done[3]["salary_min"] == 1
    again = structure.structure_postings(structure.apply_structured(base, out).select(jobs.columns).withColumn("state", F.lit(None).cast("string")), answers)
    assert again.where("job_id = 1").first()["outcome"] == "skip"
    steps = structure.pipeline_trace(out.withColumns({"fetched_at": F.lit("2024-01-01").cast("timestamp"), "checked_at": F.lit("2024-01-01").cast("timestamp"), "source_type": F.lit("lever"), "source_job_id": F.lit("j")}))
    assert steps.where("job_id = 1").count() == 5


@pytest.mark.parametrize("change, good", [({}, True), ({"more": 1}, False), ({"skills": ["x"] * 21}, False), ({"skills": [" "]}, False), ({"work_mode": "moon"}, False), ({"india_eligibility": None}, False), ({"experience_min": 9}, False), ({"experience_min": "3"}, False), ({"seniority": None}, True)])
def test_enrichment_contract(spark, change, good):
    body = {"normalized_title": "T", "role_category": None, "seniority": "s", "skills": ["a"], "experience_min": 1, "experience_max": 5, "work_mode": "remote", "india_eligibility": "india"} | change
    got = spark.createDataFrame([(json.dumps(body),)], "r string").select(structure.validate_enrichment("r").alias("e")).first()["e"]
    assert (got is not None) == good


def test_enrichment_spends_once(spark):
    ddl = "job_id long, title_original string, title_normalized string, city string, state string, description_text string, skills array<string>, experience_min double, experience_max double, work_mode string, india_relevance string, ai_enriched boolean, last_checked_at timestamp"
    jobs = spark.createDataFrame([(i, "Dev ", "dev", "X", None, "same  text", [], None, None, None, rel, False, None) for i, rel in ((1, "unknown"), (2, "unknown_remote"), (3, "india"))], ddl).withColumn("last_checked_at", F.lit("2024-01-01").cast("timestamp"))
    none = spark.createDataFrame([], "cache_key string, response string")
    _, asked = structure.enrich_jobs(jobs, none, budget=1)
    keys = [r["cache_key"] for r in asked.collect()]
    assert len(keys) == 1
    answer = {"normalized_title": "Developer", "role_category": None, "seniority": None, "skills": ["a"], "experience_min": None, "experience_max": None, "work_mode": None, "india_eligibility": "remote_india"}
    done, asked = structure.enrich_jobs(jobs, spark.createDataFrame([(keys[0], json.dumps(answer))], "cache_key string, response string"), budget=1)
    got = {r["job_id"]: (r["india_relevance"], r["title_normalized"], r["ai_enriched"]) for r in done.collect()}
    assert got == {1: ("remote_india", "Developer", True), 2: ("remote_india", "Developer", True), 3: ("india", "dev", False)} and asked.count() == 0


def test_search_is_stable_and_literal(spark):
    rows = [(i, f"T{i} 100%", "Acme", "Pune", None, "desc", "india", "active", p) for i, p in ((1, "2024-01-01"), (2, "2024-01-01"), (3, None), (4, "2024-02-01"))] + [(5, "x", "Acme", "Goa", None, "d", "not_india", "active", None)]
    jobs = spark.createDataFrame(rows, "id int, title string, company string, city string, state string, description string, relevance string, status string, p string").withColumn("posted_at", F.col("p").cast("timestamp"))
    assert [r["id"] for r in serve.search_jobs(jobs, 1, 2).collect()] + [r["id"] for r in serve.search_jobs(jobs, 2, 2).collect()] == [4, 1, 2, 3]
    assert serve.total_matches(jobs, q="100%").first()["total"] == 4 and serve.total_matches(jobs, q="1_0").first()["total"] == 0
    assert serve.get_job(jobs, 5).count() == 0 and serve.get_job(jobs, 1).count() == 1
    with pytest.raises(ValueError):
        serve.search_jobs(jobs, 0)


def test_transfer_of_nothing_and_deactivation(spark):
    jobs = spark.createDataFrame([(1, "acme", "Acme", "Pune", None, "IN", "india", "expired", None, "fp1", "ready")], "id int, company_normalized string, company_name string, city string, state string, country_code string, relevance string, status string, posted_at timestamp, exact_fingerprint string, structure_status string")
    jobs = jobs.withColumn("payload", F.struct(F.col("exact_fingerprint").alias("external_key"), F.lit("acme").alias("company_external_key"), F.lit("A").alias("company_name"), F.lit("T").alias("title"), F.lit("https://x").alias("apply_url")))
    acks = spark.createDataFrame([("a", "fp1"), ("b", "fp1")], "target string, external_key string")
    plan = sync.transfer_plan(jobs, acks, "a")
    assert {k: v.count() for k, v in plan.items()} == {"companies": 0, "jobs": 0, "reconcile": 0, "deactivate": 1, "acks": 1}
    live = sync.transfer_plan(jobs.withColumn("status", F.lit("active")), acks.limit(0), "a")
    assert {k: v.count() for k, v in live.items()} == {"companies": 1, "jobs": 1, "reconcile": 1, "deactivate": 0, "acks": 0}


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "a"}, {"id": i % 2, "title": "b"}]}))
    rows = stream.landed(spark, str(tmp_path / "in"), 1).withColumns({"source_type": F.lit("greenhouse"), "source_external_key": F.lit("k"), "fetched_at": F.lit("2024-01-01").cast("timestamp")})
    env = envelopes.envelopes_greenhouse(rows).withColumn("source_id", F.lit("s"))
    out = []
    q = stream.incremental(stream.raw_landing(env), lambda df, _: out.extend(df.select("source_job_id", F.to_json("payload")).collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(out) == len({tuple(r) for r in out}) == 3


def test_stateful_freshness(spark, tmp_path):
    rows = [(1, 1, ["a", "b"]), (1, 2, ["a"]), (1, 3, ["a"]), (1, 3, []), (1, 4, ["b"])]
    ddl = "source_id long, seq long, seen_ids array<string>"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    crawls = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = defaultdict(list)

    def keep(df, _):
        for r in df.orderBy("seq").collect():
            got[r["source_job_id"]].append((r["seq"], r["missing_count"], r["active"]))

    try:
        q = stream.stateful_freshness(crawls).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got["b"] == [(1, 0, True), (2, 1, True), (3, 2, False), (4, 0, True)]
    assert got["a"][-1] == (4, 1, True)


def test_publishing_twice_changes_nothing(spark):
    from tidewell.plans import publish

    body = "python spark data engineer builds large pipelines for analytics teams every day with care"
    job = lambda i, title, place, text: {"id": i, "title": title, "company_name": "Acme", "absolute_url": f"https://g/{i}", "content": text, "location": {"name": place}}
    page = responses(spark, "greenhouse", {"jobs": [job(1, "Data Engineer", "Pune", body), job(2, "Data Engineer", "Pune", body + " too"), job(3, "Chef", "London", body), job(4, "Clerk", "Delhi, India", body)]})
    env = envelopes.envelopes_greenhouse(page).withColumns({"source_id": F.lit("greenhouse/acme"), "id": F.col("source_job_id").cast("int")})
    known = sources(spark, ("greenhouse", "acme", "Acme"))
    none = [spark.createDataFrame([], ddl) for ddl in (publish.JOBS, publish.LINKS)]
    history = raw.with_payload_hash(env).limit(0)
    once = publish.crawl(env, history, known, *none, "2024-03-02 00:00:00")
    jobs, links = once["jobs"].collect(), once["links"].collect()
    assert sorted(r["title"] for r in jobs) == ["Clerk", "Data Engineer"] and len(links) == 3 and once["append"].count() == 4
    assert {tuple(r) for r in once["counters"].collect()} == {("greenhouse/acme", 4, 4, 0, 1)}
    twice = publish.crawl(env, once["append"], known, once["jobs"], once["links"], "2024-03-02 00:00:00")
    assert sorted(map(tuple, twice["jobs"].collect())) == sorted(map(tuple, jobs)) and sorted(map(tuple, twice["links"].collect())) == sorted(map(tuple, links))
    assert twice["append"].count() == 0
    gone = publish.crawl(env.where("id = 4"), once["append"], known, once["jobs"], once["links"], "2024-03-03 00:00:00")
    gone = publish.crawl(env.where("id = 4"), once["append"], known, gone["jobs"], gone["links"], "2024-03-04 00:00:00")
    assert {r["title"]: r["status"] for r in gone["jobs"].collect()} == {"Clerk": "active", "Data Engineer": "expired"}
