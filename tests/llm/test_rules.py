import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewell.llm import rules
from tidewell.llm.textarrays import slices

from . import brute

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(brute.by_first_words(9000, 2))


def plain(text):
    """(counts, base_failed, names of the rules that fail)."""
    x = text or ""
    w = re.findall(WORD, x)
    lines = [s for s in x.split("\n") if re.search(WORD, s)]
    runs = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    five = Counter(runs(5))
    covered = {i + j for i, r in enumerate(runs(5)) if five[r] > 1 for j in range(5)}
    dup = len(lines) - len(set(lines))
    counts = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)]
    n = len(w)
    fails = set()
    if n:
        loud = sum(len(re.findall("[A-Z]", t)) > 1 and not re.search("[a-z]", t) for t in w)
        bare = sum(not re.search(r"[A-Za-z]|[^\x00-\x7F]", t) for t in w)
        triple = max(Counter(runs(3)).values(), default=0)
        checks = {
            "word_length": not 3 * n <= counts[1] <= 10 * n, "symbols": 10 * counts[2] > n, "repeated_lines": 10 * dup > 3 * len(lines), "shouting": 10 * loud > 3 * n, "letterless": 10 * bare > 3 * n,
            "bullets": 10 * sum(s.strip(" \t\n\x0b\x0c\r")[0] in "-*•" for s in lines) > 9 * len(lines), "cut_lines": 10 * sum(s.strip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for s in lines) > 3 * len(lines),
            "common_triple": triple >= 3 and 15 * triple > n,
        }
        fails = {k for k, v in checks.items() if v}
    return counts, n < 10 or 100 * counts[4] > 20 * n, fails


def cases():
    r = random.Random(4)
    w = brute.by_first_words(300, 8)
    body = " ".join(w[:60])
    texts = [None, "", " \n\t", "one two", body, body + "\n" + body, body.upper(), "\n".join(f"- {x} {x}a\r" for x in w[:30]), "\n".join(f"{x} goes on..." for x in w[:30]), "\n".join(f"• {x}…" for x in w[:30])]
    texts += [" ".join([*w[:10], *(f"{i}-{i * i}" for i in range(100, 110))]), "a b c d e f g h i j k l m", "extraordinarily " * 3 + " ".join(w[:9]), "one of us " * 3 + body, LONG, LONG + "\n" + LONG, "naïve ÑANDÚ 日本 " + body, " ".join(x + "###" for x in w[:40])]
    texts += ["same line of words here\n" * 3 + body.replace(" ", "\n", 3), "\n\n" + body + "\n"]
    for _ in range(60):
        parts = [r.choice([body, "x " * 9, "\n", " -", "... \n", "THE BIG ONE", "…", "#", "1 2 3", *w[:20]]) for _ in range(r.randrange(1, 40))]
        texts.append(r.choice([" ", "\n", ""]).join(parts))
    return texts


def frame(spark, texts):
    rows = [(None if i % 7 == 0 else i // 2, t, "en", "s", 0, True, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, brute.DOCS + ", kept boolean, body string")


def test_rules_equal_brute_force(spark):
    texts = cases() * 2  # repeated rows
    docs = frame(spark, texts)
    out = rules.quality_rules(docs, keep=("doc_id", "body", "kept", "text")).collect()
    assert len(out) == len(texts)
    failed = Counter()
    for x in out:
        counts, base, fails = plain(x["text"])
        assert [x[c] for c in rules.COUNTS] == counts, x["text"]
        assert x["base_failed"] == base and x["kept"] == (not base and not fails), (x["text"], fails)
        assert x["failed_rule"] == "base" if base else (x["failed_rule"] in fails if fails else x["failed_rule"] is None)
        failed[x["failed_rule"]] += 1
        assert x["body"] == "x"
    assert set(failed) >= {"base", None, *rules.RULES}
    assert rules.quality_rules(docs.limit(0)).collect() == []


def test_verdicts_do_not_depend_on_the_order(spark):
    docs = frame(spark, cases())
    one = rules.quality_rules(docs, order=tuple(rules.RULES), keep=("text",)).select("text", "kept").collect()
    other = rules.quality_rules(docs, order=tuple(rules.RULES)[::-1], keep=("text",)).select("text", "kept").collect()
    assert Counter(one) == Counter(other)


def test_order_by_rejection_per_cost_among_what_is_left():
    # a rejects 40 at cost 1, b 60 at cost 2, c 50 at cost 1 of which a has 40 already
    got = rules.Estimate(("a", "b", "c"), (1.0, 2.0, 1.0), {0b101: 40, 0b100: 10, 0b010: 60, 0: 90})
    assert got.order() == ("c", "b", "a")
    assert rules.Estimate(("b", "a"), (0.0, 0.0), {}).order() == ("a", "b")


def test_later_rules_see_only_what_earlier_ones_let_through():
    seen = {}

    def spy(name, rule):
        def run(t):
            seen[name] = seen.get(name, 0) + len(t)
            return rule(t)

        return run

    texts = [t for t in cases() if t]
    _, _, data, offsets = next(slices(pa.array(texts)))
    place = rules.cascade(rules.Texts(data, offsets), {k: spy(k, f) for k, f in rules.RULES.items()})
    for i, name in enumerate(rules.RULES):
        assert seen[name] == int((place >= i).sum())
    assert np.array_equal(place < 0, [plain(t)[1] for t in texts])


def test_estimate_is_bounded_and_counts_what_fails(spark):
    docs = frame(spark, cases() * 20)
    got = rules.estimate(docs, sample_rows=50)
    assert sum(got.failing.values()) <= 50 and len(got.cost) == len(rules.RULES)
    whole = rules.estimate(docs, sample_rows=10_000)
    names = list(rules.RULES)
    want = Counter(sum(1 << names.index(f) for f in plain(t)[2]) for t in cases() * 20 if not plain(t)[1])
    assert whole.failing == dict(want) and all(c > 0 for c in whole.cost)
    assert set(rules.estimate(docs.limit(0)).order()) == set(rules.RULES)
