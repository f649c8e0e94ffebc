"""A batch gives what postings published one by one give, where likeness is transitive; a plain model replays them in order."""

import random
from collections import defaultdict

import pytest

from tidewell.plans import publish

RANKS = {"greenhouse": 0, "lever": 0, "jobboard": 1, "generic": 3}
FIELDS = (
    "source_type string, source_external_key string, source_job_id string, title_original string, company_name string, locations_raw array<string>, "
    "apply_url string, description_text string, fetched_at timestamp"
)
PLACES = {"Pune": True, "Delhi, India": True, "London": False}


def postings(seed: int, n: int, at: str, lonely: int):
    """Rows of (company, title family, place) families: titles that differ by a letter, texts by a word, some with a shared url."""
    r = random.Random(seed)
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(400)]
    rows = []
    for i in range(n):
        company, family, place = r.choice(["acme", "zenith"]), r.randrange(5), r.choice(list(PLACES))
        own = random.Random(f"{company}/{family}/{place}")
        title = f"senior {words[family]} {words[family + 50]} engineer" + r.choice(["", "s"])
        text = own.sample(words, 40)
        text[r.randrange(40)] = "changed"
        kind = r.choice(list(RANKS))
        url = f"https://x.example/{company}/{family}/{place[:3]}" if r.random() < 0.4 else f"https://x.example/only/{at[:10]}/{i}"
        rows.append((kind, f"{kind}-{company}", f"{at[:10]}-{i}", title, company, place, url, " ".join(text), at))
    # of an unknown family each: a job of their own
    rows += [("lever", "lever-acme", f"{at[:10]}-new{k}", " ".join(r.sample(words, 3)), "acme", "Pune", f"https://x.example/new/{at[:10]}/{k}", " ".join(r.sample(words, 40)), at) for k in range(lonely)]
    return rows


class OneByOne:
    """Jobs and links as one posting after the other makes them."""

    def __init__(self):
        self.jobs, self.links, self.families = {}, {}, {}

    def family(self, row):
        return (row[4], row[3].rstrip("s"), row[5])

    def find(self, row, known):
        source = (row[0], row[1], row[2])
        if source in self.links:
            return self.links[source]
        for same in (lambda j: j["print"] == (row[4], row[3], row[5]), lambda j: j["url"] == row[6], lambda j: j["family"] == self.family(row)):
            hits = [i for i in known if same(self.jobs[i])]
            if hits:
                return hits[0]
        return None

    def take(self, row):
        if not PLACES[row[5]]:
            return
        job = self.find(row, list(self.jobs))
        source = (row[0], row[1])
        if job is None:
            job = len(self.jobs)
            self.jobs[job] = {"source": None, "rank": 9, "first": row[8]}
        j = self.jobs[job]
        if j["source"] in (None, source) or RANKS[row[0]] < j["rank"]:
            j |= {"source": source, "rank": RANKS[row[0]], "print": (row[4], row[3], row[5]), "url": row[6], "family": self.family(row)}
        j["last"] = row[8]
        self.links[(*source, row[2])] = job


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_by_one(spark, seed):
    batches = [postings(seed, 40, "2024-03-01 00:00:00", 3), postings(seed + 100, 30, "2024-03-02 00:00:00", 3)]
    batches[1] += [(*x[:8], "2024-03-02 00:00:00") for x in batches[0][:5]]  # seen again: by their links
    model = OneByOne()
    jobs, links = (spark.createDataFrame([], ddl) for ddl in (publish.JOBS, publish.LINKS))
    for rows in batches:
        for row in rows:
            model.take(row)
        table = spark.createDataFrame([(*x[:5], [x[5]], *x[6:8], x[8]) for x in rows], FIELDS.replace("fetched_at timestamp", "at string")).selectExpr("*", "CAST(at AS timestamp) AS fetched_at")
        out = publish.publish(table, jobs, links)
        jobs, links = (spark.createDataFrame(out[k].collect(), ddl) for k, ddl in (("jobs", publish.JOBS), ("links", publish.LINKS)))
        got = defaultdict(set)
        for x in links.collect():
            got[x["job_id"]].add((*x["source_id"].split("/"), x["source_job_id"]))
        want = defaultdict(set)
        for source, job in model.links.items():
            want[job].add(source)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        facts = {frozenset(got[j["job_id"]]): (RANKS[j["canonical_source_type"]], str(j["first_seen_at"]), str(j["last_seen_at"]), j["status"]) for j in jobs.collect()}
        assert facts == {frozenset(want[i]): (j["rank"], j["first"], j["last"], "active") for i, j in model.jobs.items()}
