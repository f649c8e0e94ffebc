"""Similarity ratios on Arrow batches: longest common subsequence by bit-parallel words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str | bytes, b: str | bytes) -> int:
    """Length of the longest common subsequence (bit-parallel: one integer step a character of ``b``)."""
    where: dict[str | int, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b); two empty strings are equal."""
    whole = len(a) + len(b)
    return 100.0 if not whole else 200.0 * lcs_length(a, b) / whole


def set_ratio(a: str, b: str) -> float:
    """The best of three ratios among the shared words, and these with either side's own words; 0 for an empty side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    core, rest_a, rest_b = " ".join(both), " ".join(only_a), " ".join(only_b)
    gap = 1 if core else 0
    la, lb = len(core) + gap + len(rest_a), len(core) + gap + len(rest_b)
    # the two long forms begin alike, so only their ends need a subsequence
    best = 200.0 * (len(core) + gap + lcs_length(rest_a, rest_b)) / (la + lb)
    if core:
        best = max(best, 200.0 * len(core) / (len(core) + la), 200.0 * len(core) / (len(core) + lb))
    return best


#: Kinds into which characters are dealt to refuse a pair early, and what is left out for each.
KINDS = 6
_OTHERS = [bytes(b for b in range(256) if b % KINDS != k) for k in range(KINDS)]
#: Words of two blocks that are compared at once.
WORDS_AT_ONCE = 8192


def may_reach(a: str, b: str, need: int) -> bool:
    """Whether the longest common subsequence can have ``need`` characters; never false where it has.

    Each kind of characters leaves out, by itself, no more than it does among the others. So the sum over the kinds bounds what the
    texts leave out; a kind that was not looked at yet counts with the difference of its characters' numbers.
    """
    spare = len(a) + len(b) - 2 * need
    if min(len(a), len(b)) < need:
        return False
    if not (a.isascii() and b.isascii()):
        return True
    x, y = a.encode(), b.encode()
    counts = np.abs(np.bincount(np.frombuffer(x, np.uint8), minlength=128) - np.bincount(np.frombuffer(y, np.uint8), minlength=128))
    apart = [int(counts[k::KINDS].sum()) for k in range(KINDS)]
    least = sum(apart)
    for k in range(KINDS):
        if least > spare:
            return False
        kx, ky = x.translate(None, _OTHERS[k]), y.translate(None, _OTHERS[k])
        least += len(kx) + len(ky) - 2 * lcs_length(kx, ky) - apart[k]
    return least <= spare


def _shared(a: list[set[str]], b: list[set[str]]) -> np.ndarray:
    """Characters of the words that each of ``a`` shares with each of ``b``, a word with a blank; some words at once."""
    both = sorted(set().union(*a) & set().union(*b))
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(both), WORDS_AT_ONCE):
        some = {w: i for i, w in enumerate(both[lo : lo + WORDS_AT_ONCE])}
        sides = [np.zeros((len(side), len(some))) for side in (a, b)]
        for side, there in zip((a, b), sides, strict=True):
            for i, words in enumerate(side):
                there[i, [some[w] for w in words if w in some]] = 1.0
        out += (sides[0] * np.array([len(w) + 1.0 for w in some])) @ sides[1].T
    return out


def block_links(a: list[tuple[int, str]], b: list[tuple[int, str]], least: float) -> list[tuple[int, int]]:
    """Links among the groups of two blocks of (group, text), by ``set_ratio`` of at least ``least``: a forest of them, not every pair.

    All pairs of the two blocks are judged, but for those whose groups hang together by the links before. What the lengths decide is
    taken first, so that fewer pairs are left for the subsequence.
    """
    words = [[set(text.split()) for _, text in side] for side in (a, b)]
    if not words[0] or not words[1]:
        return []
    shared = _shared(*words)
    size = [np.array([sum(len(w) + 1.0 for w in x) for x in side]) for side in words]
    la, lb = size[0][:, None] - 1, size[1][None, :] - 1
    core, gap = np.maximum(shared - 1, 0), (shared > 0) * 1
    some = (la > 0) & (lb > 0)
    within = (shared > 0) & ((shared == la + 1) | (shared == lb + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.maximum(200.0 * core / (core + la), 200.0 * core / (core + lb))
    sure = some & ((within & (least <= 100.0)) | ((shared > 0) & (part >= least)))
    need = np.ceil((least - 1e-9) * (la + lb) / 200.0 - core - gap)
    perhaps = some & ~sure & (np.minimum(la, lb) - shared >= need)

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []

    def link(x: int, y: int) -> None:
        parent[max(x, y)] = min(x, y)
        found.append((max(x, y), min(x, y)))

    groups = [np.array([g for g, _ in side], dtype=np.int64) for side in (a, b)]
    other = groups[0][:, None] != groups[1][None, :]
    for i, j in np.argwhere(sure & other).tolist():
        x, y = find(a[i][0]), find(b[j][0])
        if x != y:
            link(x, y)
    kept = [[sorted(x) for x in side] for side in words]
    for i, j in np.argwhere(perhaps & other).tolist():
        x, y = find(a[i][0]), find(b[j][0])
        if x == y:
            continue
        rest_a, rest_b = " ".join(w for w in kept[0][i] if w not in words[1][j]), " ".join(w for w in kept[1][j] if w not in words[0][i])
        if may_reach(rest_a, rest_b, int(need[i, j])) and set_ratio(a[i][1], b[j][1]) >= least:
            link(x, y)
    return found


def links_of_blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(u, v) of pairs of blocks (a, b: lists of group and text), a pair at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            a, b = ([(x["group"], x["text_key"]) for x in batch.column(side)[i].as_py()] for side in ("a", "b"))
            found = block_links(a, b, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
