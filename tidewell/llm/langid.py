"""Language identification by string kernels.

The kernel of two texts is the blended spectrum: the n-grams (1 to 4 characters, lower case, hashed into ``BUCKETS``) that
both hold at least once, over the root of the product of their numbers. A bounded sample of labelled texts is
fitted by kernel ridge regression, one class against the rest, through a Nystroem approximation on landmark texts.
A text's scores are then its presence vector times one matrix, (landmark presences)' x (ridge coefficients): batches of
texts are scored as one matrix product, whatever the number of landmarks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import free_names, written

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Bounds of the training sample: labelled texts a language, and over all languages; landmarks a language.
TEXTS_A_LANGUAGE = 300
MAX_TEXTS = 6000
LANDMARKS = 50
RIDGE = 1e-2
UNDETERMINED = "und"
_BATCH = 256


def _letters() -> np.ndarray:
    kinds = np.zeros(1 << 16, dtype=bool)
    kinds[[c for c in range(1 << 16) if unicodedata.category(chr(c))[0] == "L"]] = True
    return kinds


_LETTER = _letters()


def presence(text: str) -> tuple[np.ndarray, bool]:
    """(flags of the n-gram buckets that occur in the whole text, whether it has a letter)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(codes, 65535)]
    beyond = codes > 65535
    if beyond.any():
        kinds, which = np.unique(codes[beyond], return_inverse=True)
        letter[beyond] = np.array([unicodedata.category(chr(c))[0] == "L" for c in kinds.tolist()])[which]
    flags = np.zeros(BUCKETS, dtype=bool)
    if not letter.any():
        return flags, False
    codes = np.where(letter, codes, 0).astype(np.uint64)
    # one gap stands for any run of other characters; the text begins and ends in one
    codes = np.pad(codes, 1)
    codes = codes[(codes != 0) | (np.append(np.uint64(1), codes[:-1]) != 0)]
    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            flags[((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)] = True
    return flags, True


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, bits = [], []
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            flags, known = presence(text.as_py())
            if known:
                langs.append(lang.as_py())
                bits.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bits, pa.binary())], names=["lang", "bits"])


class KernelRidge:
    """One-versus-rest ridge regression on the Nystroem features of the presence kernel."""

    def __init__(self, flags: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 1):
        """``flags``: one row of packed bits a text; they are unpacked ``_BATCH`` rows at a time. ``landmarks`` of each class."""
        self.classes = sorted(set(labels))
        own = np.array(labels)
        draw = np.random.default_rng(seed)
        pick = np.sort(np.concatenate([draw.permutation(np.flatnonzero(own == c))[:landmarks] for c in self.classes]))
        marks = self._unit(np.unpackbits(flags[pick], axis=1))
        among = (marks @ marks.T).astype(np.float64)
        to_marks = np.concatenate([self._unit(np.unpackbits(flags[lo : lo + _BATCH], axis=1)) @ marks.T for lo in range(0, len(flags), _BATCH)]).astype(np.float64)
        truth = np.where(own[:, None] == np.array(self.classes)[None, :], 1.0, -1.0)
        lhs = to_marks.T @ to_marks + ridge * len(own) / len(marks) * among + 1e-6 * np.eye(len(marks))
        self.weights = (marks.T @ np.linalg.solve(lhs, to_marks.T @ truth)).astype(np.float32)

    @staticmethod
    def _unit(flags: np.ndarray) -> np.ndarray:
        x = flags.astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return self._unit(flags) @ self.weights


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", texts_a_language: int = TEXTS_A_LANGUAGE, seed: int = 3) -> KernelRidge | None:
    """A model from a sample of the labelled rows: the ``texts_a_language`` rows of least hash of each language, fewer where there
    are so many languages that ``MAX_TEXTS`` would be exceeded; of more than ``MAX_TEXTS`` languages the commonest are learned. The
    driver holds at most that many texts' bits.

    The hash is of id and text, so rows that share an id, or have none, are drawn by themselves; of equal rows any may be drawn.
    Rows without text, language or letters are no examples. None where nothing is left.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_rank"))
    commonest = rows.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(MAX_TEXTS)
    commonest = written(commonest.select("lang"), "languages")
    texts_a_language = min(texts_a_language, MAX_TEXTS // max(1, commonest.count()))
    # each task keeps its least ranks of a language, so a language of most rows is no single task; first ranks alone, then texts
    first = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_rank"))).where(F.col("_nth") <= texts_a_language)
    last = first(rows.select("lang", "_rank")).groupBy("lang").agg(F.max("_rank").alias("_last")).join(commonest, "lang")
    sample = first(rows.join(F.broadcast(last), "lang").where("_rank <= _last")).select("text", "lang")
    rows = sample.mapInArrow(_packed, "lang string, bits binary").toPandas().sort_values(["lang", "bits"])
    if not len(rows):
        return None
    flags = np.stack([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]])
    return KernelRidge(flags, rows["lang"].tolist())


def _predict(model: KernelRidge | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        langs, scores = [UNDETERMINED] * n, np.zeros(n)
        for lo in range(0, n if model else 0, _BATCH):
            found = [presence(t.as_py() or "") for t in batch.columns[-1].slice(lo, _BATCH)]
            raw = model.scores(np.stack([f for f, _ in found]))
            top = raw.argmax(1)
            for i, (_, known) in enumerate(found):
                if known:
                    langs[lo + i] = model.classes[top[i]]
                    scores[lo + i] = min(1.0, max(0.0, (float(raw[i, top[i]]) + 1) / 2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def identify(docs: DataFrame, model: KernelRidge | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (0 to 1) for every row, from the whole text.

    Null texts and texts without a letter (empty ones too), and all texts where there is no model, are ``und`` with
    score 0. Repeated rows stay; a tie of scores goes to the first language in order; memory is bounded by ``_BATCH`` texts.
    A kept column called ``lang_pred`` or ``score`` gives way; no other name clashes.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    (body,) = free_names([*keep, "lang_pred", "score"], "body")
    narrow = docs.select(*keep, F.col(text).alias(body))
    fields = T.StructType([*narrow.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(partial(_predict, model), fields)
