"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is a linear function of features of its whole text; the chance that one document is preferred to
another is the logistic function of the difference of their scores. Preference pairs set a document marked good against
one marked bad, each good one against each bad one. The weights minimise the mean logistic loss of the pairs' feature
differences. The cut is a quantile of the training documents' scores, at the share of bad ones; ``score`` is the logistic
function of the distance to it, moved so that the quantile falls on ``CUT``.

The sums over all pairs are not made pair by pair: a document's sum over the other side is a smooth function of its score
alone, known from the moments of the other side's scores in narrow bins. A step so takes two passes over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.tables import drop_written

from .storage import free_names, hot_join, numbered, written
from .textarrays import Words, slices

#: Score at which a document counts as good.
CUT = 0.3
#: Up to so many labelled documents are fitted where they are gathered, more in passes over their table.
FEW = 4096
RIDGE = 1e-3
#: Newton steps, and rows whose features are held at once in a pass.
MAX_STEPS = 40
ROWS_AT_ONCE = 4096
#: Bins of scores in which the logistic function is a polynomial of this order to 1e-13; beyond ``FAR`` it is 0 or 1 to 1e-17.
BIN = 1 / 8
ORDER = 10
FAR = 40
#: Wider bins, and how many, for the curvature: it decides how fast the steps arrive and not where.
WIDE = 2
N_WIDE = 128

#: Kinds of bytes that are counted, one regular set a kind.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*@^~", b"-_=+", b"'\"`", b"()[]{}<>/\\", b":;"]
_KIND = np.full(256, len(KINDS), dtype=np.int64)
for _i, _set in enumerate(KINDS):
    _KIND[list(_set)] = _i
_KIND[128:] = len(KINDS) + 1
N_KINDS = len(KINDS) + 2
#: Buckets of words by hash: what is learned of the words themselves, in any script.
LEXICAL = 64
NO_TEXT = 2 * N_KINDS + 10
FEATURES = NO_TEXT + 1 + LEXICAL


def features(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES): shares of kinds of bytes and their roots, word lengths, repeats, roots of the shares of hashed words. Nulls and empty texts are all 0 but one."""
    out = np.zeros((len(column), FEATURES))
    for lo, hi, data, offsets in slices(column):
        words = Words(data, offsets)
        kind = _KIND[data]
        length = words.end - words.start
        code = words.code
        again = np.zeros(len(code), dtype=bool)
        again[1:] = code[1:] == code[:-1]
        pair = np.zeros(len(code), dtype=bool)
        pair[2:] = code[2:] == code[:-2]
        for i in range(hi - lo):
            a, b = offsets[i], offsets[i + 1]
            row, n = out[lo + i], b - a
            if n == 0:
                row[NO_TEXT] = 1
                continue
            share = np.bincount(kind[a:b], minlength=N_KINDS) / n
            row[:N_KINDS], row[N_KINDS : 2 * N_KINDS] = share, np.sqrt(share)
            w0, w1 = words.first[i], words.first[i + 1]
            count = w1 - w0
            rest = row[2 * N_KINDS : NO_TEXT]
            rest[0] = np.log1p(count)
            if count:
                size = length[w0:w1]
                distinct = len(np.unique(code[w0:w1]))
                rest[1], rest[2] = size.mean() / 10, (size > 25).mean()
                rest[3] = again[w0 + 1 : w1].sum() / count
                rest[4] = pair[w0 + 2 : w1].sum() / count
                rest[5], rest[6] = distinct / count, np.log1p(count) - np.log1p(distinct)
                rest[7], rest[8] = np.sqrt(rest[3]), np.sqrt(rest[4])
                rest[9] = n / count / 10
                row[NO_TEXT + 1 :] = np.sqrt(np.bincount((code[w0:w1] >> np.uint64(40)).astype(np.int64) % LEXICAL, minlength=LEXICAL) / count)
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # the text is the last column
        rows = [x.tobytes() for x in features(batch.columns[-1])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], names=[*batch.schema.names[:-1], "x"])


@dataclass
class BradleyTerry:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.quantile + np.log(CUT / (1 - CUT)), -50, 50)))


def _logistic_series(d: np.ndarray) -> np.ndarray:
    """(ORDER + 1, len(d)): the Taylor coefficients of the logistic function at ``d``, less a step at 0 in the first."""
    p = 1 / (1 + np.exp(-d))
    poly, out, factorial = np.array([0.0, 1.0]), [], 1.0
    for i in range(ORDER + 1):
        out.append(np.polynomial.polynomial.polyval(p, poly) / factorial)
        poly = np.polynomial.polynomial.polymul(np.polynomial.polynomial.polyder(poly), [0.0, 1.0, -1.0])  # p' = p (1 - p)
        factorial *= i + 1
    out[0] = np.where(d > 0, -1 / (1 + np.exp(d)), p)
    return np.stack(out)


@dataclass
class Field:
    """Of each score the sum, over the scores of the other side, of the logistic function: a polynomial a bin.

    ``good`` holds the sums over bad scores b of logistic(b - s), ``bad`` those over good scores a of logistic(s - a), by powers
    of the distance of s to the centre of its bin; the others the like sums of the logistic function's slope, by wide bins.
    """

    first: int
    good: np.ndarray
    bad: np.ndarray
    wide_good: np.ndarray
    wide_bad: np.ndarray

    @classmethod
    def of(cls, bins: np.ndarray, good: np.ndarray, moments: np.ndarray) -> Field:
        first, n = int(bins.min()), int(bins.max() - bins.min()) + 1
        held = np.zeros((2, n, ORDER + 1))  # moments of bad and of good scores
        np.add.at(held, (good.astype(int), bins - first), moments)
        reach = min(n - 1, int(FAR / BIN))
        series = _logistic_series(np.arange(-reach, reach + 1) * BIN)
        out = []
        for side, sign in ((0, 1), (1, -1)):
            # logistic(sign * (source - target)); source and target lie u and t from the centres of their bins
            sums = np.zeros((n, ORDER + 1))
            for p in range(ORDER + 1):
                kernel = series[p] * sign**p
                kernel = kernel if sign < 0 else kernel[::-1]  # indexed by target less source
                for q in range(p + 1):
                    sums[:, q] += comb(p, q) * (-1) ** q * np.convolve(held[side, :, p - q], kernel)[reach : reach + n]
            count = held[side, :, 0]
            below = np.cumsum(count) - count
            sums[:, 0] += below if sign < 0 else count.sum() - below - count
            out.append(sums)
        wide = wide_bins(np.arange(first, first + n))
        counts = np.stack([np.bincount(wide, held[side, :, 0], minlength=N_WIDE) for side in (0, 1)])
        return cls(first, out[0], out[1], slopes() @ counts[0], slopes() @ counts[1])


def wide_bins(bins: np.ndarray) -> np.ndarray:
    return np.clip(bins // WIDE + N_WIDE // 2, 0, N_WIDE - 1)


def slopes() -> np.ndarray:
    """The logistic function's slope at the distances between wide bins."""
    d = (np.arange(N_WIDE)[:, None] - np.arange(N_WIDE)[None, :]) * (BIN * WIDE)
    p = 1 / (1 + np.exp(-d))
    return p * (1 - p)


def _placed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each score's bin, and its distance to the centre."""
    bins = np.floor(raw / BIN).astype(np.int64)
    return bins, raw - (bins + 0.5) * BIN


def tally(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, good, moments) of the scores: one entry an occupied bin and side."""
    bins, off = _placed(z @ w)
    keys, at = np.unique(bins * 2 + good, return_inverse=True)
    moments = np.stack([np.bincount(at, off**p, minlength=len(keys)) for p in range(ORDER + 1)], axis=1) if len(keys) else np.zeros((0, ORDER + 1))
    return keys >> 1, (keys & 1).astype(bool), moments


def pulls(z: np.ndarray, good: np.ndarray, w: np.ndarray, field: Field) -> np.ndarray:
    """A flat vector of sums over these documents: the gradient, the weighted squares, and features by side and wide bin."""
    bins, off = _placed(z @ w)
    at, wide = bins - field.first, wide_bins(bins)
    powers = off[:, None] ** np.arange(ORDER + 1)
    pull = np.where(good, -(field.good[at] * powers).sum(1), (field.bad[at] * powers).sum(1))
    weight = np.where(good, field.wide_good[wide], field.wide_bad[wide])
    sums, key = np.zeros((2 * N_WIDE, z.shape[1])), good * N_WIDE + wide
    order = np.argsort(key, kind="stable")
    held, starts = np.unique(key[order], return_index=True)
    sums[held] = np.add.reduceat(z[order], starts)
    return np.concatenate([pull @ z, ((z * weight[:, None]).T @ z).ravel(), sums.ravel()])


def _newton(width: int, n_pairs: float, tally_all: Callable, pull_all: Callable) -> np.ndarray:
    """Weights of least loss over all pairs; a step that makes the gradient longer is halved."""
    w, step, size = np.zeros(width), np.zeros(width), np.inf
    for _ in range(MAX_STEPS):
        sums = pull_all(w, Field.of(*tally_all(w))) / n_pairs
        grad = sums[:width] + RIDGE * w
        if np.linalg.norm(grad) > max(size, 1e-12):
            step = step / 2
            w = w + step
            continue
        size = np.linalg.norm(grad)
        bad, good = sums[width + width * width :].reshape(2, N_WIDE, width)
        cross = good.T @ slopes() @ bad * n_pairs
        hess = sums[width : width + width * width].reshape(width, width) - cross - cross.T
        step = np.linalg.solve(hess + RIDGE * np.eye(width), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_pairs(x: np.ndarray, good: np.ndarray) -> BradleyTerry:
    """Weights from all pairs (good, bad) by Newton steps on the ridged logistic loss; without pairs every score is the cut."""
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = (x - mean) / spread
    n_good = int(good.sum())
    if not n_good or n_good == len(x):
        return BradleyTerry(np.zeros(x.shape[1]), mean, spread, 0.0)
    w = _newton(x.shape[1], n_good * (len(x) - n_good), lambda w: tally(z, good, w), lambda w, field: pulls(z, good, w, field))
    return BradleyTerry(w, mean, spread, float(np.quantile(z @ w, (~good).mean())))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, good) of some rows at once."""
    for batch in batches:
        for lo in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            yield np.frombuffer(b"".join(part["x"].to_pylist())).reshape(len(part), -1), part["quality"].to_numpy() == 1


def _flat(v: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if v is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])


def _spread_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for x, good in _arrays(batches):
        held = _merged(held, np.concatenate([[len(x), good.sum()], x.mean(0), ((x - x.mean(0)) ** 2).sum(0)]))
    yield from _flat(held)


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Rows, good ones, means and squared distances to them of two sets of rows together."""
    if a is None:
        return b
    (na, nb), width = (a[0], b[0]), (len(a) - 2) // 2
    apart = b[2 : 2 + width] - a[2 : 2 + width]
    mean = a[2 : 2 + width] + apart * (nb / (na + nb))
    squares = a[2 + width :] + b[2 + width :] + apart**2 * (na * nb / (na + nb))
    return np.concatenate([a[:2] + b[:2], mean, squares])


def _tally_part(mean, spread, w, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, good in _arrays(batches):
        bins, side, moments = tally((x - mean) / spread, good, w)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(side), *map(pa.array, moments.T)], names=["bin", "good", *[f"m{p}" for p in range(ORDER + 1)]])


def _pull_part(mean, spread, w, field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for x, good in _arrays(batches):
        v = pulls((x - mean) / spread, good, w, field)
        held = v if held is None else held + v
    yield from _flat(held)


def _sum_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for v in batch["v"]:
            v = np.frombuffer(v.as_buffer())
            held = v.copy() if held is None else held + v
    yield from _flat(held)


def _raw_part(mean, spread, w, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, _ in _arrays(batches):
        yield pa.RecordBatch.from_arrays([pa.array(((x - mean) / spread) @ w)], names=["raw"])


def _fit_table(rows: DataFrame) -> BradleyTerry:
    """``fit_pairs`` of a written table (quality, x), in passes: only sums leave the tasks."""
    held = None
    for r in rows.mapInArrow(_spread_part, "v binary").collect():
        held = _merged(held, np.frombuffer(r.v))
    (n, n_good), (mean, squares) = held[:2], np.split(held[2:], 2)
    spread = np.sqrt(squares / n)
    spread = np.where(spread > 1e-9, spread, 1.0)
    if n_good in (0, n):
        return BradleyTerry(np.zeros(len(mean)), mean, spread, 0.0)
    names = [f"m{p}" for p in range(ORDER + 1)]

    def tally_all(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = "bin long, good boolean, " + ", ".join(f"{m} double" for m in names)
        found = rows.mapInArrow(partial(_tally_part, mean, spread, w), kinds).groupBy("bin", "good").agg(*[F.sum(m).alias(m) for m in names]).toArrow()
        return found["bin"].to_numpy(), found["good"].to_numpy(), np.stack([found[m].to_numpy() for m in names], axis=1)

    def pull_all(w: np.ndarray, field: Field) -> np.ndarray:
        parts = rows.mapInArrow(partial(_pull_part, mean, spread, w, field), "v binary").repartition(8).mapInArrow(_sum_part, "v binary")
        return np.sum([np.frombuffer(r.v) for r in parts.collect()], axis=0)

    w = _newton(len(mean), n_good * (n - n_good), tally_all, pull_all)
    raw = rows.mapInArrow(partial(_raw_part, mean, spread, w), "raw double")
    at = (n - 1) * (1 - n_good / n)  # between two neighbours in the order of the scores
    low = int(at)
    ordered = numbered(raw.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "raw-scores", F.col("raw"), F.col("tie"))
    near = [r.raw for r in ordered.where(F.col("_nth").isin(low, low + 1)).select("raw").orderBy("raw").collect()]
    return BradleyTerry(w, mean, spread, float(near[0] + (at - low) * (near[-1] - near[0])))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "quality", max_labelled: int | None = None, seed: int = 11) -> BradleyTerry:
    """Learn from every labelled document; with ``max_labelled`` from at most so many: a share of the ids by hash, and of their rows those of least hash.

    A label belongs to all rows of its id; rows that repeat an id are documents of their own, and of equal rows any may be
    taken. Labels that are null, or of a null id, are none; an id with several has the highest. Without labels or documents, or
    with labels of one kind only, every score is the cut. Null, empty and very long texts are documents like others; other columns
    are not read.
    """
    marks = labels.where(F.col(mark).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(mark).cast("int").alias("quality"))
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    if max_labelled is not None:
        total = max(1, marks.count())
        share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
        marks = marks.where(share < min(1.0, max_labelled / total))  # so bounded, the sample may be broadcast
        sample = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "quality", F.xxhash64(F.lit(seed), "doc_id", "text").alias("rank"), "text")
        rows = sample.mapInArrow(_featurise, f"doc_id {kind}, quality int, rank long, x binary").orderBy("rank").limit(max_labelled).drop("rank")
        return _fit_gathered(rows)
    counts = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    facts = written(marks.join(counts, "doc_id"), "labels")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the features are moved and not the texts, which may be much longer
    found = hot_join(texts.mapInArrow(_featurise, f"doc_id {kind}, x binary"), facts, "doc_id", "n", total).select("doc_id", "quality", "x")
    if total <= FEW:
        return _fit_gathered(found)
    rows = written(found.select("quality", "x"), "labelled", facts)
    model = _fit_table(rows)
    drop_written(rows)
    return model


def _fit_gathered(rows: DataFrame) -> BradleyTerry:
    found = rows.select("doc_id", "quality", "x").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(found["x"].to_pylist())).reshape(-1, FEATURES)
    return fit_pairs(x, found["quality"].to_numpy() == 1)


def _score(model: BradleyTerry, out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # the text to score is the last column
        scores = model.score(features(batch.columns[-1]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], out])


def scored(docs: DataFrame, model: BradleyTerry, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns with ``out`` for every row, from the whole text; null and empty texts get the score of no text.

    Equal texts get equal scores, repeated rows stay, a very long text is scored as one, and an empty table gives an empty
    result. A kept column that is called ``out`` gives way to the score; no other name clashes.
    """
    keep = tuple(c for c in keep if c != out)
    (body,) = free_names([*keep, out], "body")
    narrow = docs.select(*keep, F.col(text).alias(body))
    fields = T.StructType([*narrow.schema.fields[:-1], T.StructField(out, T.DoubleType())])
    return narrow.mapInArrow(partial(_score, model, out), fields)
