"""Samples that models are fitted on, and draws, when ids are null or repeated and rows are equal."""

import random
from collections import Counter

from tidewell.llm import langid, mixing, quality

from . import brute


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], brute.DOCS)


def test_every_language_is_learned_whatever_the_ids(spark, monkeypatch):
    r = random.Random(1)
    held = []
    monkeypatch.setattr(langid, "KernelRidge", lambda flags, langs: held.append(Counter(langs)))
    vowels, others = "aeiou", "bcdfg"
    word = lambda: "".join(r.choice(vowels) + r.choice(others) for _ in range(4))
    rows = [(None, f"{word()} {word()} the {i}", "en", "s") for i in range(5000)] + [(i, f"{word()} el {i}", "es", "s") for i in range(400)]
    rows += [(7, "siempre lo mismo", "pt", "s")] * 900 + [(None, "immer dasselbe", "de", "s")] * 900
    docs = frame(spark, rows)
    for seed in (3, 5, 6):
        langid.fit(docs, seed=seed)
    assert held == [Counter({"en": 300, "es": 300, "pt": 300, "de": 300})] * 3
    held.clear()
    monkeypatch.setattr(langid, "MAX_TEXTS", 3)
    langid.fit(docs)
    assert held == [Counter({"en": 1, "pt": 1, "de": 1})]  # the commonest; of equal counts the first by name


def test_the_labelled_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, good, *a: seen.append((len(x), int(good.sum()))))
    rows = [(1, f"text number {i % 700}", "en", "s") for i in range(100_000)] + [(2, "THE OTHER ONE!!", "en", "s"), (None, "no id", "en", "s")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    quality.fit(frame(spark, rows), labels, max_labelled=5000)
    quality.fit(frame(spark, rows[-3:]), labels)
    quality.fit(frame(spark, []), labels)
    assert seen[0][0] == 5000 and seen[1:] == [(2, 1), (0, 0)]


def test_equal_rows_are_drawn_like_others(spark):
    rows = [(5, "one and the same text", "en", "s")] * 900 + [(1000 + i, f"text {i} of its own", "en", "s") for i in range(900)]
    out = mixing.pareto_mix(frame(spark, rows), weights=(1.0,), share=0.5).collect()
    taken = Counter(x["doc_id"] == 5 for x in out if x["taken"])
    assert sum(taken.values()) == 900 and abs(taken[True] - 450) < 75  # five deviations
