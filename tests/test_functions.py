import datetime as dt
import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import facts, fixed, geo, similarity, text


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], ddl) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, want", [("Acme Pvt. Ltd.", "acme"), ("Inc", "inc"), ("The Co Company, LLC", "the"), ("Limited Brands", "limited brands"), ("", ""), ("Zoë & Söhne", "zo s hne")])
def test_company(spark, name, want):
    assert one(spark, text.normalize_company("c"), c=name) == want


@pytest.mark.parametrize("url, want", [
    ("https://Jobs.Example.com/A/?utm_source=x&b=1#frag", "https://jobs.example.com/a/?b=1"), ("https://e.com/p?UTM_Medium=1&gclid=2", "https://e.com/p"),
    ("https://e.com/p///", "https://e.com/p"), ("https://e.com/p?a", "https://e.com/p?a="), ("e.com/p", None), ("", None), (None, None), ("  https://e.com  ", "https://e.com"),
    ("https://e.com/p?q=a b", "https://e.com/p?q=a+b"), ("https://e.com?x=1/", "https://e.com?x=1%2f"), ("https://e.com/p?lever-source=z", "https://e.com/p"),
])
def test_url(spark, url, want):
    assert one(spark, text.normalize_url("u"), u=url) == want


def test_text_shapes(spark):
    assert one(spark, text.fuzzy_title("t"), t="Sr. Dev / Jr QA") == "senior dev junior qa"
    assert one(spark, text.normalize_location("t"), t="Gurgaon, HR (Bangalore)") == "gurugram hr bengaluru"
    assert one(spark, text.token_fingerprint("t"), t="To be the cat, THE dog") == "cat dog the"
    assert one(spark, text.token_fingerprint("t"), t=None) == ""
    assert one(spark, text.blank_to_null("t"), t="  ") is None
    assert one(spark, text.requisition_key("c", "r"), c="Acme Inc", r="R-1") == "acme|r 1"
    assert one(spark, text.requisition_key("c", "r"), c="Acme Inc", r=None) is None
    assert one(spark, text.contains_text("t", "50%_"), t="Save 50%_ now") and not one(spark, text.contains_text("t", "5_%"), t="Save 50% now")
    assert one(spark, text.experience_label("a", "b"), a=0, b=5) == "0–5 years" and one(spark, text.experience_label("a", "b"), a=3, b=7) == "3–7 years"


def test_html(spark):
    body = "<p>A &amp; B</p><script>x<y</script><style>p{}</style><!-- c --> &lt;b&gt;"
    assert one(spark, text.html_to_text("t"), t=body) == "A & B <b>"
    assert one(spark, text.plain_text("t"), t="&lt;p&gt;Hi&lt;/p&gt;  <b>you</b>") == "Hi you"
    assert one(spark, text.html_to_text("t"), t="<br>") is None
    assert one(spark, text.unescape("t"), t="&eacute;&#39;") == html.unescape("&eacute;&#39;")


def test_times(spark):
    utc = lambda *a: dt.datetime(*a)
    got = lambda s: one(spark, F.date_format(text.parse_iso_ts("t"), "yyyy-MM-dd HH:mm"), t=s)
    assert got("2024-01-02T03:04:05Z") == "2024-01-02 03:04" and got("20240102") == "2024-01-02 00:00" and got("2024-01-02T03:04:05+05:30") == "2024-01-01 21:34"
    assert got("soon") is None and got("") is None
    assert one(spark, text.iso_z(text.parse_epoch(F.lit(1700000000000)))) == one(spark, text.iso_z(text.parse_epoch(F.lit(1700000000)))) == utc(2023, 11, 14, 22, 13, 20).strftime("%Y-%m-%dT%H:%M:%SZ")


# Labelled places and the relevance they have.
PLACES = [
    (["Bengaluru"], None, None, None, "india"), (["Karnataka"], None, None, None, "india"), (["India"], None, None, None, "india"), (["Bangalore"], None, None, None, "india"),
    (["Bombay"], None, None, None, "india"), (["Gurgaon"], None, None, None, "india"), (["Bengaluru-VTP, India"], None, None, None, "india"), (["hyderabad"], None, None, None, "india"),
    (["London", "Mumbai"], None, None, None, "india"), (["Remote"], None, None, "IN", "india"), (["Remote - India"], None, None, None, "india"),
    (["Remote"], None, "Open to candidates in India.", None, "remote_india"), (["Work from home"], None, "This role is India only.", None, "remote_india"),
    (["San Francisco, United States"], None, None, None, "not_india"), (["New York, NY"], None, None, None, "not_india"), (["Remote - US only"], None, None, None, "not_india"),
    (["Remote"], None, None, "US", "not_india"), (["Athens, Attica, Greece"], None, None, None, "not_india"), (["London, United Kingdom"], None, None, None, "not_india"),
    (["San Francisco, CA"], None, "We serve customers in India from our US headquarters.", None, "not_india"), (["Remote"], None, "Worldwide, excluding India.", None, "not_india"),
    (["Indianapolis, IN"], None, None, None, "not_india"), (["Lahore, Punjab, Pakistan"], None, None, None, "not_india"), (["Remote"], None, None, None, "unknown_remote"),
    (["Worldwide"], None, None, None, "unknown_remote"), (["Anywhere"], None, None, None, "unknown_remote"), ([], None, "This is a fully remote position.", None, "unknown_remote"),
    ([], "Software Engineer", None, None, "unknown"), (["HQ"], None, None, None, "unknown"),
]


def test_relevance(spark):
    df = spark.createDataFrame(PLACES, "l array<string>, t string, d string, c string, want string")
    rows = df.withColumn("got", geo.classify_relevance("l", "t", "d", "c")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_places(spark):
    place = lambda s: tuple(one(spark, geo.split_place("l"), l=[s]))
    assert place("Pune, Maharashtra, India") == ("Pune", "Maharashtra", "IN") and place("Berlin") == ("Berlin", None, None) and place("in") == (None, None, "IN")
    assert one(spark, geo.fill_state("c", "s"), c="x", s="ka") == "Karnataka" and one(spark, geo.fill_state("c", "s"), c="Pune", s=" ") == "Maharashtra"
    assert one(spark, geo.fill_state("c", "s"), c="Oz", s=None) is None and one(spark, geo.fill_state("c", "s"), c="x", s="Bihar") == "Bihar"
    match = lambda a, b: one(spark, geo.locations_match("a", "b"), a=a, b=b)
    assert match("Pune", "Pune, India") and match("Remote", "remote") and not match("Remote, India", "Remote") and not match("Pune, MH", "Pune, India") and not match("Pune", "Delhi")
    mode = lambda t, c, r: one(spark, geo.infer_work_mode(F.lit(None).cast("string"), "t", "c", "r"), t=t, c=c, r=r)
    assert [mode("Hybrid", "", "x"), mode("x", "", "remote_india"), mode("in-office", "", "x"), mode("x", "Pune", "india"), mode("x", "", "india")] == ["hybrid", "remote", "onsite", "onsite", None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_ratios_equal_the_plain_table(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.ratio(a, a) == 100.0 and similarity.ratio(a, b) == similarity.ratio(b, a)
    x, y = set(a.split()), set(b.split())
    if x and y:
        core = " ".join(sorted(x & y))
        long = [(core + " " + " ".join(sorted(s))).strip() for s in (x - y, y - x)]
        want = 100.0 if core and (x <= y or y <= x) else max([similarity.ratio(*long)] + ([similarity.ratio(core, s) for s in long] if core else []))
        assert similarity.set_ratio(a, b) == pytest.approx(want)


@pytest.mark.parametrize("body, want", [
    ("15-20 LPA", (1500000, 2000000, "year")), ("₹80,000 per month", (80000, None, "month")), ("Competitive pay, 5 years", None), ("20 to 15 lakhs", (1500000, 2000000, "year")),
    ("12.5 lakh per annum", (1250000, None, "year")), ("Rs. 50,000 - 40,000 / month", (40000, 50000, "month")), ("INR ,,,,", (None, None, "year")),
])
def test_salary(spark, body, want):
    s = one(spark, facts.parse_salary("t"), t=body)
    assert (s and (s["salary_min"], s["salary_max"], s["salary_period"])) == want


def test_facts(spark):
    assert [one(spark, facts.normalize_employment("t"), t=x) for x in ("Full-Time", "internship", "Freelance!", "volunteer", "")] == ["full_time", "internship", "contract", None, None]
    f = one(spark, facts.coerce_facts("t"), t='```json\n{"summary": 5, "skills": ["a", 1, "b"], "work_mode": "moon", "experience_min_years": true, "benefits": "x"}\n```')
    assert f["summary"] is None and f["skills"] == ["a", "b"] and f["work_mode"] is None and f["experience_min_years"] is None and f["benefits"] == []
    assert one(spark, facts.coerce_facts("t"), t="[1]") is None and one(spark, facts.coerce_facts("t"), t="nope") is None
    assert one(spark, facts.ground_skills("s", "t"), s=["C++", "SQL", "Go"], t="We use sql and c.") == ["C++", "SQL"]
    years = lambda y, lab, t: tuple(one(spark, facts.ground_experience("y", "l", "t"), y=float(y), l=lab, t=t))
    assert years(5, "5+ years", "at least 5 years") == (5.0, "5+ years") and years(5, "5+", "15 years") == (None, None) and years(5, "7 years", "5 years") == (5.0, None)
    assert one(spark, facts.leftover_text("t", "l"), t="alpha beta gamma delta", l=["alpha beta gamma"]) is None
    assert one(spark, facts.leftover_text("t", "l"), t="alpha beta", l=["alpha"]) == "alpha beta"
    assert one(spark, facts.lines("l"), l=[" a ", "", "b" * 600]) == ["a", "b" * 500]


def test_fixed_values_are_lower_case_and_distinct():
    for name in ("STATES", "CITIES", "REMOTE_INDIA_PHRASES", "FOREIGN_COUNTRIES", "FOREIGN_CITIES", "US_STATES"):
        values = getattr(fixed, name)
        assert len(set(values)) == len(values) and all(v == v.lower() for v in values), name
