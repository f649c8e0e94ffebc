import hashlib
import random
import zlib
from functools import cache

import pytest

from tidewell.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, part int, digests string, conv string"


def faults(rows):
    """(turn, role, text) in order -> fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired lines), by trying every edit; the least audit of the cheapest."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    state = {"s": 1, "u": 2, "a": 3}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, q, put):
        ways = []
        if i == len(rows) and q in (0, 3):
            ways.append((0, "", ()))
        if put < 3:  # three in a row are never needed
            cost, audit, lines = best(i, state[step[q]], put + 1)
            ways.append((cost + 3, "I" + audit, (f"{name[step[q]]}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, q, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if marks[i] not in ("blank", "duplicate"):
                more = 3 if marks[i] == "truncated" else 0
                cost, audit, lines = best(i + 1, state[step[q]], 0)
                ways.append((cost + 3 + more, "R" + audit, (f"{name[step[q]]}:{text}", *lines)))
                if role[:1] == step[q] or (q == 0 and role[:1] == "s"):
                    cost, audit, lines = best(i + 1, state[role[:1]], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, 0, 0)


def plain(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    marks = faults(rows)
    cost, audit, lines = cheapest(tuple(rows), tuple(marks))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No", "What? ", "  ", "", "Go on!", "cut off,", "Ende.\n", "naïve…", None]
    out = []
    for c in range(n):
        conv = None if c == 3 else c
        for t in range(r.randrange(0, longest)):
            turn = None if r.random() < 0.1 else t + (r.random() < 0.2)
            text = r.choice(texts) if r.random() < 0.5 else f"{c} {t}{r.choice('.!?,')}"
            out.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
            if r.random() < 0.1:
                out.append(out[-1])
        if c % 5 == 0:
            out.append((conv, 99, "user", "dropped", True))
    return [(*x[:4], len(x) > 4, 1, "d", "v") for x in out]


def expected(rows):
    by = {}
    for conv, turn, role, text, gone, *_ in rows:
        by.setdefault(conv, [])
        if not gone:
            by[conv].append((turn, role, text))
    return {c: plain(x) for c, x in by.items()}


def result(df):
    return {x["conv_id"]: tuple(x[c] for c in (*dialogue.COUNTS, "audit", "repaired_sha256")) for x in df.collect()}


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_equals_brute_force(spark, chunk):
    """With chunks of three rows nearly every conversation is taken in chunks."""
    rows = conversations(5, 120, 9) + conversations(6, 1, 60)
    got = result(dialogue.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), gone="gone", chunk_rows=chunk))
    assert got == expected(rows)


def test_one_conversation_of_many_equal_rows(spark):
    rows = [(1, 0, "user", "Same.", False, 1, "d", "v")] * 300 + [(1, i, "assistant" if i % 2 else "user", f"t{i}.", False, 1, "d", "v") for i in range(1, 400)] + [(2, 0, "user", "A.", False, 1, "d", "v")]
    got = result(dialogue.repair_conversations(spark.createDataFrame(rows, SCHEMA), gone="gone"))
    assert got[1][:6] == (0, 0, 299, 0, 299, 4 * 299) and got[1][6] == "K" + "D" * 299 + "K" * 399
    assert got[2] == plain([(0, "user", "A.")])


def test_empty_tables_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair_conversations(empty, gone="gone").collect() == []
    rows = [(7, 0, "user", "x" * 3_000_000, False, 1, "d", "v"), (7, 1, "assistant", "y" * 3_000_000 + ".", False, 1, "d", "v")]
    assert result(dialogue.repair_conversations(spark.createDataFrame(rows, SCHEMA)))[7] == plain([r[1:4] for r in rows])


def test_vectors_are_few_and_blocks_equal_single_steps():
    t = dialogue.tables()
    assert len(t.vectors) < 100 and t.before.shape[0] == dialogue.N_SYMBOLS**dialogue.WIDTH
    r = random.Random(1)
    for _ in range(300):
        symbols = bytes(r.randrange(9) for _ in range(r.randrange(30)))
        vector, cost = dialogue.END, 0
        for s in reversed(symbols):
            vector = dialogue._before(s, vector)
        got, edits, state = dialogue.repair(symbols)
        assert got == vector[0]
        spent = {"D": 4, "K": 0, "u": 3, "a": 3, "U": 3, "A": 3}
        kept = iter(symbols)
        for e in edits + dialogue._tail(state):
            cost += spent[e]
            if e not in "UA":
                s = next(kept)
                cost += 3 * (e != "D" and s > 0 and (s - 1) % 2)
        assert cost == got and next(kept, None) is None


def test_damage(spark):
    rows = [(c, t, "assistant", "Well. Yes! Is it?") for c in (1, None) for t in (*range(40), None)] + [(5, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if k == 4 else role, "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text, k == 0)
        want += [new] * (2 if k == 3 else 1)
    df = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, (tuple(r)[:5] for r in df.collect()))) == sorted(map(repr, want))
