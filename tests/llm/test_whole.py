"""The quality model is learned from every labelled document and all pairs of them."""

import random

import numpy as np
import pyarrow as pa

from tidewell.llm import quality

from . import brute


def test_all_labelled_documents_and_all_pairs_have_a_say(spark):
    r = random.Random(8)
    words = brute.by_first_words(60, 5)
    texts = [" ".join(r.choices(words, k=r.randint(1, 6))) + "!" * (i % 3) for i in range(20_400)] + [""] * 100
    good = np.array([(len(t) + r.randint(0, 30)) % 60 > 25 for t in texts])
    docs = spark.createDataFrame([(i // 2 if i < 600 else i, t, "en", "s", 0) for i, t in enumerate(texts)], brute.DOCS)  # some ids twice
    good[1:600:2] = good[0:600:2]
    labels = spark.createDataFrame([(i // 2 if i < 600 else i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    model = quality.fit(docs, labels)

    x = quality.features(pa.array(texts))
    spread = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    assert np.allclose(model.mean, x.mean(0), atol=1e-12) and np.allclose(model.spread, spread, atol=1e-9)
    z = (x - model.mean) / model.spread
    raw = z @ model.weights
    assert abs(model.quantile - np.quantile(raw, (~good).mean())) < 1e-9
    pull, n = np.zeros(len(raw)), good.sum() * (~good).sum()
    for part in np.array_split(np.flatnonzero(good), 40):  # the plain sum over the pairs
        wrong = 1 / (1 + np.exp(raw[part][:, None] - raw[~good][None, :]))
        pull[part] -= wrong.sum(1)
        pull[~good] += wrong.sum(0)
    assert np.abs(quality.RIDGE * model.weights + pull @ z / n).max() < 1e-8
    local = quality.fit_pairs(x, good)
    assert np.allclose(local.weights, model.weights, atol=1e-7) and abs(local.quantile - model.quantile) < 1e-7


def test_scores_far_apart_and_equal_ones_sum_like_pairs():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(150, 3)), r.normal(size=(10, 3)) * 900, np.zeros((40, 3))])
    good = np.arange(200) % 3 == 0
    w = np.array([1.0, 0.1, -0.5])
    s = x @ w
    wrong = 1 / (1 + np.exp(np.clip(s[good][:, None] - s[~good][None, :], -500, 500)))
    want = wrong.sum(0) @ x[~good] - wrong.sum(1) @ x[good]
    got = quality.pulls(x, good, w, quality.Field.of(*quality.tally(x, good, w)))[:3]
    assert np.allclose(got, want, rtol=1e-11, atol=1e-9)
