"""The similarity join loses no pair and makes few that are none."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.similarity import block_links, lcs_length, may_reach, ratio, set_ratio
from tidewell.operators import resolve, similar


def title_rows(spark, titles, company="c"):
    return spark.createDataFrame([(company, t, True, True) for t in titles], "company_key string, title_key string, a boolean, b boolean")


def edited(r, t, n):
    for _ in range(n):
        i = r.randrange(len(t) + 1)
        t = t[:i] + r.choice(["", r.choice("abcxyz 019")]) + t[i + r.randrange(2) :]
    return " ".join(t.split())


@pytest.mark.parametrize("least", [92.0, 95.0])
def test_no_near_title_is_lost(spark, least):
    r = random.Random(int(least))
    words = ["engineer", "senior", "data", "aa", "a", "b", "manager", "sales", "ii", "go", "lead", "platform"]
    titles = {" ".join(r.choices(words, k=r.randrange(1, 7))) for _ in range(150)} | {"a" * n for n in (1, 2, 5, 6, 7, 12, 13, 30, 31, 33)} | {"", "ab", "abc", "abcdef", "abcdefg"}
    titles |= {edited(r, t, r.randrange(1, 5)) for t in sorted(titles)}
    got = {(x["a_title"], x["b_title"]) for x in similar.near_titles(title_rows(spark, titles), least).collect()}
    assert got == {(a, b) for a in titles for b in titles if ratio(a, b) >= least}


def test_ratios_at_which_grams_lose_pairs_are_refused(spark):
    assert similar.lossless(92.0) and not similar.lossless(90.0)
    with pytest.raises(ValueError):
        similar.title_candidates(title_rows(spark, ["a"]), 90.0)


def test_candidates_are_few(spark):
    r = random.Random(3)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    vocabulary = ["".join(r.choices(syllables, k=r.randrange(2, 5))) for _ in range(900)]
    titles = {" ".join(r.choices(vocabulary, k=3)) for _ in range(1500)}
    titles |= {edited(r, t, 1) for t in sorted(titles)[:100]}
    found = similar.title_candidates(title_rows(spark, titles)).count()
    assert found < len(titles) ** 2 / 100


def test_titles_of_other_companies_and_sides_do_not_meet(spark):
    rows = [("c", "data engineer", True, False), ("c", "data engineers", False, True), ("d", "data engineerss", False, True), (None, "data engineer", False, True), ("c", None, False, True)]
    got = similar.near_titles(spark.createDataFrame(rows, "company_key string, title_key string, a boolean, b boolean")).collect()
    assert [tuple(x) for x in got] == [("c", "data engineer", "data engineers")]


def postings(spark, n, seed):
    r = random.Random(seed)
    words = ["python", "spark", "sales", "benefits", "travel", "remote", "team", "build", "pipelines", "friendly", "large"]
    rows = []
    for i in range(n):
        title = r.choice(["Data Engineer", "Data Engineer II", "Senior Data Engineer", "Sr Data Engineer", "Sales Lead", "Sales Leads", "QA"])
        rows.append((i, r.choice(["Acme Inc", "ACME", "Globex"]), title, r.choice(["Pune", "Pune, India", "India", "Mumbai", "Remote - India", ""]), None if i % 17 == 0 else " ".join(r.sample(words, r.randrange(1, 9)))))
    return resolve.with_identity(
        spark.createDataFrame(rows, "candidate_id long, company_name string, title string, location string, description string").withColumns({"requisition_id": F.lit(None).cast("string"), "canonical_url": F.lit(None).cast("string")})
    )


def generic_match(a, b):
    from tidewell.functions import fixed

    x, y = set(a.split()), set(b.split())
    return a == b or (bool((x & y) - set(fixed.GENERIC_LOCATION_TOKENS)) and (x <= y or y <= x))


def test_near_postings_equal_all_pairs(spark):
    p = postings(spark, 160, 8).cache()
    rows = p.collect()
    want = {
        (a["candidate_id"], b["candidate_id"])
        for a in rows for b in rows
        if a["company_key"] == b["company_key"] and generic_match(a["location_key"], b["location_key"]) and ratio(a["title_key"], b["title_key"]) >= 92
        and a["text_key"] and b["text_key"] and set_ratio(a["text_key"], b["text_key"]) >= 88
    }
    jobs = p.withColumnRenamed("candidate_id", "job_id")
    assert {tuple(x) for x in resolve.fuzzy_pairs(p, jobs).collect()} == want and len(want) > 300
    least = {}
    for a, b in want:
        least[a] = min(b, least.get(a, b))
    assert {tuple(x) for x in resolve.fuzzy_matches(p, jobs).collect()} == set(least.items())
    parent = {x["candidate_id"]: x["candidate_id"] for x in rows}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert {x["candidate_id"]: x["cluster"] for x in resolve.clusters(p, keys=()).collect()} == parent


def test_equal_postings_are_compared_once(spark):
    one = postings(spark, 1, 2).withColumn("description", F.lit("build large pipelines"))
    many = spark.range(3000).withColumnRenamed("id", "candidate_id").crossJoin(one.drop("candidate_id"))
    many = resolve.with_identity(many.select("candidate_id", "company_name", "title", "location", "description", "requisition_id", "canonical_url"))
    alike = similar.classes(many, "candidate_id")
    assert similar.near_classes(alike, alike).count() == 1
    assert resolve.clusters(many, keys=()).select("cluster").distinct().collect() == [(0,)]


def test_bound_on_texts_never_refuses_a_near_pair(spark):
    r = random.Random(5)
    words = ["python", "pythons", "spark", "sparks", "ab", "abc", "data", "date"]
    texts = sorted({" ".join(sorted(set(r.choices(words, k=r.randrange(1, 7))))) for _ in range(90)})
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for x in df.select("a", "b", similar.may_be_near("a", "b", 88.0).alias("ok")).collect():
        assert x["ok"] or set_ratio(x["a"], x["b"]) < 88


def test_exact_matches_make_no_comparison_by_likeness(spark, monkeypatch):
    monkeypatch.setattr(resolve, "near_classes", None)
    rows = [(1, "Acme", "Data Engineer", "Pune"), (2, "ACME Inc", "data engineer", "pune"), (3, "Acme", "Data Engineers", "Pune")]
    blank = {c: F.lit(None).cast("string") for c in ("requisition_id", "canonical_url", "source_id", "source_job_id")}
    p = resolve.with_identity(spark.createDataFrame(rows, "candidate_id long, company_name string, title string, location string").withColumn("description", F.lit("spark")).withColumns(blank))
    got = resolve.find_exact(p.where("candidate_id > 1"), p.where("candidate_id = 1").withColumnRenamed("candidate_id", "job_id"))
    assert [tuple(x) for x in got.collect()] == [(2, 1)]


def test_titles_of_random_letters_have_hardly_a_candidate(spark):
    titles = [row[0] for row in spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256)).collect()]
    near = [titles[0][:20] + titles[0][21:], titles[1][:9] + "zz" + titles[1][11:]]
    found = {tuple(sorted(x[1:])) for x in similar.title_candidates(title_rows(spark, titles + near)).collect()}
    assert {tuple(sorted(x)) for x in zip(titles, near)} <= found and len(found) < 20


def least_of(nodes, links):
    """The least node that each node hangs together with."""
    least = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near_texts(r, n):
    """Texts of which some hold others, some differ by letters only (no word shared), some by words."""
    syllables = ["the", "an", "er", "ti", "on", "re", "le", "ou", "sh", "ly"]
    word = lambda: "".join(r.choices(syllables, k=r.randrange(1, 4)))
    base = [sorted({word() for _ in range(r.randrange(1, 40))}) for _ in range(n)]
    base += [sorted({w + "s" for w in x}) for x in base[: n // 3]] + [sorted(set(x) | {word() for _ in range(3)}) for x in base[: n // 3]]
    return [" ".join(x) for x in base] + ["zürich köln", "zurich koln", "", "a"]


@pytest.mark.parametrize("least", [60.0, 88.0, 100.0])
def test_links_of_blocks_join_what_all_pairs_join(least):
    r = random.Random(int(least))
    for _ in range(6):
        texts = near_texts(r, 25)
        rows = [(r.randrange(40), t) for t in texts]
        a, b = rows[: r.randrange(1, len(rows))], rows[r.randrange(len(rows)) :]
        want = {(x, y) for x, t in a for y, u in b if x != y and set_ratio(t, u) >= least}
        got = block_links(a, b, least)
        assert least_of(range(40), got) == least_of(range(40), want) and len(got) == 40 - len(set(least_of(range(40), want).values()))


def test_kinds_of_characters_refuse_no_pair_that_reaches():
    r = random.Random(9)
    texts = near_texts(r, 40) + ["".join(r.choices("abcdefgh ", k=60)) for _ in range(20)]
    refused = 0
    for a in texts:
        for b in texts:
            n = lcs_length(a, b)
            assert may_reach(a, b, n) and may_reach(a, b, 0)
            refused += not may_reach(a, b, int(0.88 * max(len(a), len(b))))
    assert refused > len(texts) ** 2 / 2


def test_rows_of_one_key_are_not_compared_by_text(spark, monkeypatch):
    """3,000 texts of one title and place are one group by their fingerprint: no pair of them is looked at."""
    monkeypatch.setattr(resolve, "near_classes", None)
    handed = []
    monkeypatch.setattr(resolve, "near_links", lambda rows: handed.append(rows) or similar.near_links(rows))
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    rows = [(i, "Acme", "QA", "Pune", " ".join(r.sample(words, 30))) for i in range(3000)] + [(3000, "Acme", "QA", "Pune, India", " ".join(r.sample(words, 30)))]
    p = spark.createDataFrame(rows, "candidate_id long, company_name string, title string, location string, description string")
    p = resolve.with_identity(p.withColumns({c: F.lit(None).cast("string") for c in ("requisition_id", "canonical_url")}))
    assert {x[0]: x[1] for x in resolve.clusters(p).collect()} == {i: i // 3000 * 3000 for i in range(3001)}
    assert handed[0].count() == 3001 and similar.near_links(handed[0].where("least < 3000")).count() == 0


@pytest.mark.parametrize("keys", [(), ("fingerprint",)])
def test_small_blocks_group_like_all_pairs(spark, monkeypatch, keys):
    monkeypatch.setattr(similar, "BLOCK", 2)
    p = postings(spark, 150, 12).cache()
    rows = p.collect()
    links = {
        (a["candidate_id"], b["candidate_id"])
        for a in rows for b in rows
        if any(a[k] == b[k] for k in keys) or (
            a["company_key"] == b["company_key"] and generic_match(a["location_key"], b["location_key"]) and ratio(a["title_key"], b["title_key"]) >= 92
            and a["text_key"] and b["text_key"] and set_ratio(a["text_key"], b["text_key"]) >= 88
        )
    }
    assert {x["candidate_id"]: x["cluster"] for x in resolve.clusters(p, keys=keys).collect()} == least_of([x["candidate_id"] for x in rows], links)


def test_without_jobs_nothing_is_compared(spark, monkeypatch):
    monkeypatch.setattr(resolve, "near_classes", None)
    p = postings(spark, 20, 3)
    got = resolve.fuzzy_matches(p, p.withColumnRenamed("candidate_id", "job_id").where("job_id < 0"))
    assert got.columns == ["candidate_id", "job_id"] and got.count() == 0
