"""Quality rules as a short-circuit cascade.

Each rule looks at a slice of whole texts and says which of them fail. What a rule costs and what it rejects is estimated on
a sample; the cascade then runs the rules by falling rejection per cost, each only on the texts that all rules before it have
let through. The order decides the time only: a text is kept where no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import free_names
from .textarrays import Words, _powers, _BYTE_CODE, mix64, slices

#: Rows of the sample on which cost and selectivity are estimated, at most.
SAMPLE_ROWS = 4096

_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_LETTER = _UPPER | _LOWER | (_BYTES >= 128)
_CONTINUES = (_BYTES & 0xC0) == 0x80


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], ... start[0] + count[0] - 1, start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def _again(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, shared): which entries have an equal one in the same row before them, and which have one anywhere in it."""
    order = np.lexsort((code, row))  # stable: equal entries stay in order
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (row[order[1:]] == row[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
    later, shared = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    shared[order] = both
    return later, shared


class Texts:
    """A slice of texts: bytes, words and lines, and the counts of the base. ``take`` gives those of some rows without cutting words again."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=False)
        self.data, self.offsets = data, offsets
        self.start, self.end, self.code, self.first = words.start, words.end, words.code, words.first
        self.word_row = np.repeat(np.arange(len(self)), np.diff(self.first))
        self._lines()
        self.n_words = np.diff(self.first)
        self.word_chars = self._by_row(_sums(~_CONTINUES[data])[self.end] - _sums(~_CONTINUES[data])[self.start])
        symbols = _sums(_SYMBOL[data])
        self.n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        later, _ = _again(self.line_row, self._line_codes())
        self.n_lines = np.bincount(self.line_row, minlength=len(self))
        self.n_dup_lines = np.bincount(self.line_row[later], minlength=len(self))
        self.n_repeat_words = self.repeated_words(5)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def _by_row(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_row, weights=value, minlength=len(self)).astype(np.int64)

    def _lines(self) -> None:
        """Lines with a word: where each begins and ends, its row, its first and last word."""
        breaks = np.flatnonzero(self.data == 10)
        begins = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        ends = np.append(begins[1:], len(self.data))
        w0, w1 = np.searchsorted(self.start, begins), np.searchsorted(self.start, ends)
        full = w1 > w0
        begins, ends = begins[full], ends[full]
        self.line_start, self.line_end = begins, ends - ((ends > begins) & (self.data[ends - 1] == 10))
        self.line_first, self.line_last = w0[full], w1[full] - 1
        self.line_row = np.searchsorted(self.offsets, begins, "right") - 1

    def _line_codes(self) -> np.ndarray:
        size = self.line_end - self.line_start
        at = _ranges(self.line_start, size)
        place = _ranges(np.zeros(len(size), dtype=np.int64), size)
        if not len(size):
            return np.zeros(0, dtype=np.uint64)
        return mix64(np.add.reduceat(_BYTE_CODE[self.data[at]] * _powers(int(size.max()))[place], np.cumsum(size) - size))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, row, code) of every run of ``width`` words."""
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        at = _ranges(self.first[:-1], n)
        code = np.zeros(len(at), dtype=np.uint64)
        for j in range(width):
            code = mix64(code + self.code[at + j] + np.uint64(j))
        return at, np.repeat(np.arange(len(self)), n), code

    def repeated_words(self, width: int) -> np.ndarray:
        """Words of each row that lie in a run of ``width`` words found twice or more in it."""
        at, row, code = self.windows(width)
        hit = at[_again(row, code)[1]]
        change = np.zeros(len(self.code) + 1, dtype=np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + width, -1)
        return self._by_row(np.cumsum(change[:-1]) > 0)

    def commonest(self, width: int) -> np.ndarray:
        """How often the commonest run of ``width`` words occurs in each row."""
        _, row, code = self.windows(width)
        order = np.lexsort((code, row))
        edge = np.ones(len(order), dtype=bool)
        edge[1:] = (row[order[1:]] != row[order[:-1]]) | (code[order[1:]] != code[order[:-1]])
        most = np.zeros(len(self), dtype=np.int64)
        np.maximum.at(most, row[order[edge]], np.diff(np.append(np.flatnonzero(edge), len(order))))
        return most

    def take(self, rows: np.ndarray) -> Texts:
        out = object.__new__(Texts)
        n_bytes, n_words = np.diff(self.offsets)[rows], np.diff(self.first)[rows]
        out.data = self.data[_ranges(self.offsets[rows], n_bytes)]
        out.offsets, out.first = np.concatenate([[0], np.cumsum(n_bytes)]), np.concatenate([[0], np.cumsum(n_words)])
        words = _ranges(self.first[rows], n_words)
        moved, renumbered = out.offsets[:-1] - self.offsets[rows], out.first[:-1] - self.first[rows]
        out.start, out.end, out.code = self.start[words] + np.repeat(moved, n_words), self.end[words] + np.repeat(moved, n_words), self.code[words]
        out.word_row = np.repeat(np.arange(len(rows)), n_words)
        first_line = np.searchsorted(self.line_row, np.arange(len(self) + 1))
        n_lines = np.diff(first_line)[rows]
        lines = _ranges(first_line[rows], n_lines)
        out.line_row = np.repeat(np.arange(len(rows)), n_lines)
        out.line_start, out.line_end = self.line_start[lines] + np.repeat(moved, n_lines), self.line_end[lines] + np.repeat(moved, n_lines)
        out.line_first, out.line_last = self.line_first[lines] + np.repeat(renumbered, n_lines), self.line_last[lines] + np.repeat(renumbered, n_lines)
        for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
            setattr(out, name, getattr(self, name)[rows])
        return out


Rule = Callable[[Texts], np.ndarray]


def base_failed(t: Texts) -> np.ndarray:
    """Fewer than ten words, or more than a fifth of the words in five-word runs that occur again."""
    return (t.n_words < 10) | (100 * t.n_repeat_words > 20 * t.n_words)


def word_length(t: Texts) -> np.ndarray:
    """A mean word of fewer than 3 or more than 10 characters."""
    return (t.word_chars < 3 * t.n_words) | (t.word_chars > 10 * t.n_words)


def symbols(t: Texts) -> np.ndarray:
    """More than one symbol to ten words."""
    return 10 * t.n_symbols > t.n_words


def repeated_lines(t: Texts) -> np.ndarray:
    """More than three lines in ten that have occurred before."""
    return 10 * t.n_dup_lines > 3 * t.n_lines


def _per_word(t: Texts, kind: np.ndarray) -> np.ndarray:
    sums = _sums(kind[t.data])
    return sums[t.end] - sums[t.start]


def shouting(t: Texts) -> np.ndarray:
    """More than three words in ten with two capitals (A-Z) or more and no small letter (a-z)."""
    loud = (_per_word(t, _UPPER) > 1) & (_per_word(t, _LOWER) == 0)
    return 10 * t._by_row(loud) > 3 * t.n_words


def letterless(t: Texts) -> np.ndarray:
    """More than three words in ten without a letter (A-Z, a-z, or any character that is not ASCII)."""
    return 10 * t._by_row(_per_word(t, _LETTER) == 0) > 3 * t.n_words


def bullets(t: Texts) -> np.ndarray:
    """More than nine lines in ten that begin with ``-``, ``*`` or a bullet."""
    at = t.start[t.line_first]
    head = t.data[at]
    third = np.minimum(at + 2, len(t.data) - 1)
    dot = (head == 0xE2) & (t.data[np.minimum(at + 1, len(t.data) - 1)] == 0x80) & (t.data[third] == 0xA2)
    return 10 * np.bincount(t.line_row[(head == 45) | (head == 42) | dot], minlength=len(t)) > 9 * t.n_lines


def cut_lines(t: Texts) -> np.ndarray:
    """More than three lines in ten whose last word ends with three dots or an ellipsis."""
    end = t.end[t.line_last]
    size = end - t.start[t.line_last]
    a, b, c = (t.data[np.maximum(end - k, 0)] for k in (3, 2, 1))
    cut = (size >= 3) & (((a == 46) & (b == 46) & (c == 46)) | ((a == 0xE2) & (b == 0x80) & (c == 0xA6)))
    return 10 * np.bincount(t.line_row[cut], minlength=len(t)) > 3 * t.n_lines


def common_triple(t: Texts) -> np.ndarray:
    """A run of three words that occurs three times or more and makes up more than a fifth of the words."""
    most = t.commonest(3)
    return (most >= 3) & (15 * most > t.n_words)


#: The rules of the cascade by name; a text that fails the base is not looked at again.
RULES: dict[str, Rule] = {f.__name__: f for f in (word_length, symbols, repeated_lines, shouting, letterless, bullets, cut_lines, common_triple)}


@dataclass(frozen=True)
class Estimate:
    """What the sample says: seconds of each rule a row, and rows by the rules that they fail (bits in the order of ``names``)."""

    names: tuple[str, ...]
    cost: tuple[float, ...]
    failing: dict[int, int]

    def order(self) -> tuple[str, ...]:
        """By turns the rule of most rejections per cost among the sample's rows that no rule before it rejects; ties by name."""
        left, chosen = dict(self.failing), []
        rest = sorted(range(len(self.names)), key=lambda i: self.names[i])
        while rest:
            hits = {i: sum(n for bits, n in left.items() if bits >> i & 1) for i in rest}
            best = max(rest, key=lambda i: (hits[i] / max(self.cost[i], 1e-12), -self.cost[i]))
            chosen.append(self.names[best])
            rest.remove(best)
            left = {bits: n for bits, n in left.items() if not bits >> best & 1}
        return tuple(chosen)


def _measure(rules: dict[str, Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(batch.columns[0]):
            t = Texts(data, offsets)
            t = t.take(np.flatnonzero(~base_failed(t)))
            if not len(t):
                continue
            bits, spent = np.zeros(len(t), dtype=np.int64), []
            for i, rule in enumerate(rules.values()):
                began = time.perf_counter()
                bits |= rule(t).astype(np.int64) << i
                spent.append(time.perf_counter() - began)
            found, n = np.unique(bits, return_counts=True)
            kind = pa.array([*["rule"] * len(rules), *["failing"] * len(found)])
            key = pa.array([*range(len(rules)), *found.tolist()], pa.int64())
            value = pa.array([*spent, *n.astype(float).tolist()], pa.float64())
            yield pa.RecordBatch.from_arrays([kind, key, value], names=["kind", "key", "value"])


def estimate(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Estimate:
    """Cost and selectivity of each rule on a random sample of at most ``sample_rows`` texts; without rows all costs are 0."""
    total = docs.count()
    sample = docs.select(text).sample(min(1.0, sample_rows / max(total, 1)), seed).limit(sample_rows)
    rows = sample.mapInArrow(partial(_measure, rules), "kind string, key long, value double").groupBy("kind", "key").agg(F.sum("value")).collect()
    spent = {k: v for kind, k, v in rows if kind == "rule"}
    failing = {k: int(v) for kind, k, v in rows if kind == "failing"}
    seen = max(1, sum(failing.values()))
    return Estimate(tuple(rules), tuple(spent.get(i, 0.0) / seen for i in range(len(rules))), failing)


def cascade(t: Texts, rules: dict[str, Rule]) -> np.ndarray:
    """The place of the first of ``rules`` that each text fails; -1 where it fails the base, ``len(rules)`` where it fails none."""
    out = np.where(base_failed(t), -1, len(rules))
    alive = np.flatnonzero(out >= 0)
    t = t if len(alive) == len(t) else t.take(alive)
    for i, rule in enumerate(rules.values()):
        if not len(alive):
            break
        fails = rule(t)
        if fails.any():
            out[alive[fails]] = i
            alive, t = alive[~fails], t.take(np.flatnonzero(~fails))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(rules: dict[str, Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array(["base", *rules, None], dtype=object)
    for batch in batches:  # the text to judge is the last column
        for lo, hi, data, offsets in slices(batch.columns[-1]):
            t = Texts(data, offsets)
            place = cascade(t, rules)
            made = [pa.array(getattr(t, c).astype(np.int64)) for c in COUNTS]
            made += [pa.array(place < 0), pa.array(names[place + 1].tolist(), pa.string()), pa.array(place == len(rules))]
            kept = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], *(f"made{i}" for i in range(len(made)))])


def quality_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, order: tuple[str, ...] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with the counts of the whole text, ``base_failed``, ``failed_rule`` and ``kept`` for every row.

    ``order`` names the rules in the order of the cascade; without it the order is estimated on a sample of the rows. A text is
    kept where neither the base nor a rule rejects it, whatever the order; ``failed_rule`` is the first that does (``base``
    for the base, null where the text is kept) and follows the order. Null and empty texts have no words and fail the base.
    Repeated rows stay, ties cannot occur, an empty table gives an empty result, and memory is bounded by a slice (1 MB, or
    one longer text). A kept column called like one of the results gives way; no other name clashes.
    """
    made = [*COUNTS, "base_failed", "failed_rule", "kept"]
    keep = tuple(c for c in keep if c not in made)
    order = order or estimate(docs, rules, text).order()
    (body,) = free_names([*keep, *made], "body")
    narrow = docs.select(*keep, F.col(text).alias(body))
    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.StringType(), T.BooleanType()]
    fields = T.StructType([*narrow.schema.fields[:-1], *(T.StructField(c, k) for c, k in zip(made, kinds, strict=True))])
    return narrow.mapInArrow(partial(_judge, {name: rules[name] for name in order}), fields)
