import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import ranking

from . import brute

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, brute.lower(text or ""))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by reading every document for every item."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, length = sum(size > 0 for _, _, size in bags), sum(size for _, _, size in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        found = []
        for doc, bag, size in bags:
            if size:
                m = 100 - 75 + (75 * size * n) // length
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return out


@pytest.fixture(scope="module")
def odd():
    r = random.Random(7)
    w = brute.by_first_words(120, 3)
    docs = [(i, " ".join(r.choices(w, k=r.randrange(1, 60)))) for i in range(150)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (200, None), (201, ""), (202, " --- \n"), (203, "Ñandú ÑANDÚ naïve_naïve 日本 x9"), (204, docs[5][1].upper()), (205, " ".join(r.choices(w, k=60_000)))]
    items = [(i, " ".join(r.choices(w, k=r.randrange(1, 12)))) for i in range(30)]
    items += [(1, items[0][1]), (None, items[0][1] + " " + items[0][1]), (50, None), (51, "..."), (52, "unknownword"), (53, "Ñandú 日本"), (54, " ".join(w))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "en", "s", 0, 5, 6) for i, t in docs], brute.DOCS + ", rank int, item long"), spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, score int")


@pytest.mark.parametrize("block_terms", [1 << 16, 40, 1])
def test_ranking_equals_brute_force(spark, odd, block_terms):
    d, q = frames(spark, *odd)
    out = [tuple(r) for r in ranking.rank_documents(d.repartition(3), q, block_terms=block_terms).collect()]
    assert Counter(out) == Counter(plain(*odd))


def test_nothing_to_rank(spark, odd):
    d, q = frames(spark, *odd)
    assert ranking.rank_documents(d.limit(0), q).collect() == []
    assert ranking.rank_documents(d, q.limit(0)).collect() == []


def test_shared_sets_are_made_once_and_items_keep_their_terms():
    r = random.Random(2)
    common = [{f"c{k}{i}": 1 for i in range(6)} for k in range(3)]
    items = {i: common[i % 3] | {f"own{i}": 2, "the": r.randrange(1, 3)} for i in range(60)}
    p = ranking.compile_block(items)
    inside = [[leaf] for leaf in range(len(p.leaves))]
    for a, b in p.pairs:
        inside.append(inside[a] + inside[b])
    for item, rest in zip(p.items, p.rests, strict=True):
        held = sorted(p.leaves[leaf] for node in rest for leaf in inside[node])
        assert held == sorted((p.terms.index(t), n) for t, n in items[item].items())
    shared, apart = p.additions()
    assert apart == sum(len(bag) - 1 for bag in items.values()) and shared < apart / 2
    assert all(a < len(p.leaves) + i and b < len(p.leaves) + i for i, (a, b) in enumerate(p.pairs))


def test_length_norm_beyond_64_bits():
    n = np.array([10**12, 3])
    assert ranking.length_norm(n, 10**10, 10**14).tolist() == [25 + 75 * 10**12 * 10**10 // 10**14, 25 + 75 * 3 * 10**10 // 10**14]
