"""Fitted models and the permutation against second, plain forms of the same rules."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewell.llm import langid, minhash, quality, trainorder

from . import brute


def grams(text: str) -> set[str]:
    """N-grams of one to four characters of letters, with one gap for any run of others and at both ends."""
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {plain[i : i + n] for n in langid.ORDERS for i in range(len(plain) - n + 1)}


def test_kernel_ridge_equals_a_plain_solve():
    """Kernels as sizes of set intersections, solved by weights of texts; hashing moves a score by little and no verdict."""
    r = random.Random(4)
    vocab = {"aa": brute.by_first_words(40, 1), "bb": ["".join(reversed(w)) for w in brute.by_first_words(40, 2)], "cc": [w[::2] + "zo" for w in brute.by_first_words(40, 3)]}
    known = [(" ".join(r.choices(vocab[k], k=12)), k) for k in vocab for _ in range(15)]
    fresh = [" ".join(r.choices(vocab[k], k=12)) for k in vocab for _ in range(10)] + [" ".join(r.choices(vocab["aa"], k=6) + r.choices(vocab["bb"], k=6))]
    model = langid.KernelRidge(np.stack([np.packbits(langid.presence(t)[0]) for t, _ in known]), [k for _, k in known])

    unit = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    sets = [grams(t) for t, _ in known]
    kernel = np.array([[unit(a, b) for b in sets] for a in sets])  # every text is a landmark
    truth = np.array([[1.0 if k == c else -1.0 for c in vocab] for _, k in known])
    lhs = kernel.T @ kernel + langid.RIDGE * kernel + 1e-6 * np.eye(len(sets))
    alpha = np.linalg.solve(lhs, kernel.T @ truth)
    want = np.array([[unit(grams(t), b) for b in sets] for t in fresh]) @ alpha
    got = model.scores(np.stack([langid.presence(t)[0] for t in fresh]))
    assert model.classes == sorted(vocab)
    assert np.abs(got - want).max() < 0.05
    assert (got.argmax(1) == want.argmax(1))[:30].all() and (got.argmax(1)[:30] == np.repeat(range(3), 10)).all()


def test_presence_equals_sets_of_grams():
    for text in ("Hello, hello  world", "é日本 x9y", "a", "ab--cd\n\nab"):
        flags, letters = langid.presence(text)
        assert letters and len(grams(text)) - 2 <= flags.sum() <= len(grams(text))
    assert langid.presence("12 !?")[1] is False


def plain_features(text: str) -> list[float]:
    """The features but those of hashed words, by strings."""
    data, words = text.encode(), brute.words(text)
    kinds = [sum(b in k for b in data) for k in quality.KINDS]
    wide = sum(b >= 128 for b in data)
    share = [x / len(data) for x in [*kinds, len(data) - sum(kinds) - wide, wide]]
    n = len(words)
    out = share + [math.sqrt(x) for x in share] + [math.log1p(n)]
    if not n:
        return out + [0.0] * 9
    sizes = [len(w.encode()) for w in words]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    pair = sum(a == b for a, b in zip(words, words[2:], strict=False)) / n
    distinct = len(set(words))
    return out + [
        sum(sizes) / n / 10, sum(s > 25 for s in sizes) / n, again, pair, distinct / n, math.log1p(n) - math.log1p(distinct),
        math.sqrt(again), math.sqrt(pair), len(data) / n / 10,
    ]


def test_features_equal_plain_counts():
    texts = ["one two two three one two", "naïve #1 | x_y", "a" * 40 + " b b b", "x y x y x", "!", "end.\n\nnext line, here: (ok)"]
    got = quality.features(pa.array([*texts, None, "", " \n"], pa.string()))
    for row, text in zip(got, texts, strict=False):
        assert row[: quality.NO_TEXT] == pytest.approx(plain_features(text))
        assert (row[quality.NO_TEXT + 1 :] ** 2).sum() == pytest.approx(1) and row[quality.NO_TEXT] == 0
    assert (got[-3:-1, quality.NO_TEXT] == 1).all() and np.count_nonzero(got[-3:-1]) == 2
    assert got[-1][: quality.NO_TEXT] == pytest.approx(plain_features(" \n"))


def test_pair_weights_are_the_minimum_of_the_plain_loss():
    """One good document: its pairs with all bad ones are each drawn once, so the whole loss is known."""
    r = np.random.default_rng(3)
    x = r.normal(size=(41, 6))
    x[:, 5] = 2.0  # a feature without spread has no say
    good = np.arange(41) == 7
    model = quality.fit_pairs(x, good)
    z = [[(v - m) / s for v, m, s in zip(row, model.mean, model.spread, strict=True)] for row in x.tolist()]

    def loss(w):
        pairs = [sum(wi * (a - b) for wi, a, b in zip(w, z[7], z[j], strict=True)) for j in range(41) if j != 7]
        return sum(math.log1p(math.exp(-p)) for p in pairs) / 40 + quality.RIDGE / 2 * sum(wi * wi for wi in w)

    best = model.weights.tolist()
    for i in range(6):
        up, down = ([w + e * (k == i) for k, w in enumerate(best)] for e in (1e-4, -1e-4))
        assert abs(loss(up) - loss(down)) / 2e-4 < 1e-6
    assert loss(best) < loss([0.0] * 6) and abs(best[5]) < 1e-9
    raw = sorted(sum(w * v for w, v in zip(best, row, strict=True)) for row in z)
    at = 40 * (40 / 41)  # the quantile at the share of bad ones, between two neighbours
    assert model.quantile == pytest.approx(raw[int(at)] + (at - int(at)) * (raw[min(40, int(at) + 1)] - raw[int(at)]))
    assert model.score(x)[7] == pytest.approx(1 / (1 + math.exp(model.quantile - sum(w * v for w, v in zip(best, z[7], strict=True)) - math.log(0.3 / 0.7))))


def plain_slot(number: int, n: int, key: int) -> int:
    """The keyed network on integers, walked until it falls below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    slot = n
    while slot >= n:
        left, right = number >> half, number & mask
        for i in range(trainorder.ROUNDS):
            h = xxhash.xxh64_intdigest(struct.pack("<q", key + i), 42)
            left, right = right, left ^ (xxhash.xxh64_intdigest(struct.pack("<q", right), h) & mask)
        number = slot = left << half | right
    return slot


@pytest.mark.parametrize("n", [1, 2, 5, 257, 1025])
def test_slots_equal_a_second_network(spark, n):
    got = trainorder.with_slots(spark.range(n).withColumnRenamed("id", "number"), n).select("number", "slot").collect()
    assert {x["number"]: x["slot"] for x in got} == {i: plain_slot(i, n, trainorder.KEY) for i in range(n)}


def test_links_of_a_block_are_a_forest_over_its_groups():
    draw = np.random.default_rng(7)
    for share, n_groups in ((0.02, 60), (0.1, 60), (0.6, 60), (1.0, 60), (0.3, 9)):
        group = draw.integers(0, n_groups, 60)
        near = np.triu(draw.random((60, 60)) < share, 1) & (group[:, None] != group[None, :])

        def parts(pairs, group=group):
            name = {g: g for g in group.tolist()}
            for a, b in pairs:
                x, y = name[group[a]], name[group[b]]
                name = {g: min(x, y) if v in (x, y) else v for g, v in name.items()}
            return name

        a, b = minhash._forest(near, group)
        whole = parts(zip(*np.nonzero(near), strict=True))
        assert near[a, b].all() and parts(zip(a, b, strict=True)) == whole
        assert len(a) == len(set(group.tolist())) - len(set(whole.values()))
