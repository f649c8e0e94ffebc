"""Training-order materialisation: token-id sequences in fixed-stride binary shards.

Documents become sequences of a fixed number of token ids. Their order by document fixes the number of each sequence; a keyed Feistel network over the next even power of two, walked until it falls below the number of sequences,
maps that number to a global slot, a permutation without a table of its own. Ranges of slots are shards: every
sequence takes the same number of bytes, so slot s lies at byte (s mod a shard's sequences) * stride of shard s div that
number, and a reader resumes anywhere by arithmetic.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import counted, shuffles_dropped, written

#: Token ids of a sequence, sequences of a shard file, key of the permutation.
SEQUENCE = 1024
SHARD_SEQUENCES = 4096
KEY = 0x5DEECE66D
ROUNDS = 4
#: Byte vocabulary: ids are the values of a text's bytes; two that no UTF-8 text has are end of text and padding.
END, PAD = 0xFF, 0xFE
DTYPE = "u1"
#: Sequences are packed between the steps; a shard holds them plain.
_CODEC = pa.Codec("zstd", 1)


def byte_tokens(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file_tokens(path: str, pattern: str, text: str) -> np.ndarray:
    """Token ids by a vocabulary file of byte-pair ranks that lies at the same path on every worker; with it ``dtype`` is
    "<u2" (or "<u4"), and ``end`` and ``pad`` are ids that the file leaves free."""
    return np.array(_encoding(path, pattern).encode_ordinary(text), dtype=np.uint32)


def _mix(x: F.Column, key: int, half: int) -> F.Column:
    return F.xxhash64(F.lit(key), x).bitwiseAND(F.lit((1 << half) - 1))


def feistel(x: F.Column, half: int, key: int = KEY, rounds: int = ROUNDS) -> F.Column:
    """One pass of the network on ``2 * half`` bits."""
    left, right = F.shiftright(x, half), x.bitwiseAND(F.lit((1 << half) - 1))
    for i in range(rounds):
        left, right = right, left.bitwiseXOR(_mix(right, key + i, half))
    return F.shiftleft(left, half).bitwiseOR(right)


def with_slots(numbered: DataFrame, n: int, key: int = KEY) -> DataFrame:
    """``numbered`` (``number`` from 0 to n - 1) with ``slot``: the permutation, by cycle-walking.

    The domain has at most four times n values, so a walk takes four steps at most on average. The walk is a fold over a few steps
    that keeps a value once it is below n, and over ever more steps for the few rows that are not there yet. One of more
    than 1,600 steps (a chance below 1e-200) ends the job with an error: no row is given a slot that is none.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    walk = lambda s, _: F.when(s < n, s).otherwise(feistel(s, half, key))
    placed = numbered.withColumn("slot", feistel(F.col("number"), half, key))
    for steps in (8, 64, 1600):
        further = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("slot"), walk)
        placed = placed.withColumn("slot", F.when(F.col("slot") < n, F.col("slot")).otherwise(further))
    return placed.withColumn("slot", F.when(F.col("slot") < n, F.col("slot")).otherwise(F.raise_error("a cycle walk of the permutation did not end")))


def _sequences(length: int, dtype: str, tokenise: Callable[[str], np.ndarray], end: int, pad: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    parts: list = []
    fills: list = []
    rows: list = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(fills, pa.int32()), pa.array(rows, pa.binary())],
            names=["doc_id", "part", "n_tokens", "tokens"],
        )
        for x in (ids, parts, fills, rows):
            x.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch["doc_id"], pc.fill_null(batch["text"], ""), strict=True):
            tokens = np.append(tokenise(text.as_py()), end).astype(dtype)
            for part, lo in enumerate(range(0, len(tokens), length)):
                piece = tokens[lo : lo + length]
                ids.append(doc.as_py())
                parts.append(part)
                fills.append(len(piece))
                whole = np.concatenate([piece, np.full(length - len(piece), pad, dtype=dtype)])
                rows.append(_CODEC.compress(whole.tobytes(), asbytes=True))
                if len(rows) >= 1000:
                    yield flush()
    if rows:
        yield flush()


def _unpacked(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            rows = [_CODEC.decompress(x.as_buffer(), size, asbytes=True) for x in part["tokens"]]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.binary())], names=part.schema.names)


def stride_of(length: int, dtype: str = DTYPE) -> int:
    """Bytes from one sequence of a shard to the next: its ids and one closing line feed."""
    return length * np.dtype(dtype).itemsize + 1


def slotted(
    docs: DataFrame, length: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, tokenise: Callable[[str], np.ndarray] = byte_tokens,
    end: int = END, pad: int = PAD, dtype: str = DTYPE, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(slot, shard, offset, doc_id, part, n_tokens, tokens): the sequences, packed, with the place of each.

    Documents are put in order of id and text before they are cut, so a sequence's number, and with it its slot, depends on
    the documents alone and not on files, splits or the size of the cluster.
    """
    mark = F.xxhash64(text)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), mark.alias("mark"), F.monotonically_increasing_id().alias("tie"))
    narrow = narrow.repartitionByRange("doc_id", "mark", "tie").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    pieces = narrow.mapInArrow(partial(_sequences, length, dtype, tokenise, end, pad), "doc_id long, part int, n_tokens int, tokens binary")
    pieces = written(pieces.withColumn("_id", F.monotonically_increasing_id()), "sequences")
    total = pieces.count()
    placed = with_slots(counted(pieces).withColumnRenamed("_nth", "number"), max(1, total), key)
    return placed.select(
        "slot", F.floor(F.col("slot") / shard_sequences).cast("long").alias("shard"),
        ((F.col("slot") % shard_sequences) * stride_of(length, dtype)).cast("long").alias("offset"), "doc_id", "part", "n_tokens", "tokens",
    )


def _in_order(placed: DataFrame, length: int, dtype: str) -> DataFrame:
    """Ranges of whole shards, each in order of slots, unpacked."""
    rows = placed.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    return rows.mapInArrow(partial(_unpacked, length * np.dtype(dtype).itemsize), "slot long, shard long, offset long, doc_id long, part int, n_tokens int, tokens binary")


def training_order(docs: DataFrame, length: int = SEQUENCE, dtype: str = DTYPE, **how) -> DataFrame:
    """One row per sequence: slot, shard, offset (bytes into the shard), doc_id, part, n_tokens, tokens (little-endian ids).

    A document is its token ids and an end mark, cut every ``length`` ids, the last piece padded. Null and empty texts are one
    sequence of the end mark; repeated rows are sequences of their own; null ids come first; a very long text is many sequences; an empty table
    gives an empty result; other columns are not read. Slots are 0 to (sequences - 1) without gaps. ``how`` as in :func:`slotted`.
    """
    return _in_order(slotted(docs, length, dtype=dtype, **how), length, dtype)


def write_shards(docs: DataFrame, path: str, length: int = SEQUENCE, dtype: str = DTYPE, **how) -> DataFrame:
    """Write the shards to ``path`` and give the index (slot, shard, offset, doc_id, part, n_tokens) of what lies where.

    A shard is one file ``shard=<number>/part-*.txt`` of plain bytes: its sequences in order of slots, each of
    ``stride_of(length, dtype)`` bytes. Sequence s is at byte (s mod a shard's sequences) * stride, whatever reads it: no
    file has to be unpacked or read from its start. Spark's text writer is used (it writes a string's bytes as they are), so ``path`` may be in any store.
    """
    placed = slotted(docs, length, dtype=dtype, **how)
    rows = _in_order(placed, length, dtype).sortWithinPartitions("shard", "slot").select("shard", F.col("tokens").cast("string").alias("value"))
    with shuffles_dropped(docs.sparkSession):
        rows.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").mode("overwrite").text(path)
    return placed.drop("tokens")


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, length) of the shard files; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("shard").cast("long").alias("shard"), "path", "length")


def read_slots(spark: SparkSession, path: str, start: int, n: int, length: int = SEQUENCE, dtype: str = DTYPE, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences of slots start, start + 1, ...: each file is opened at the byte where the first one lies. Ends with the last sequence."""
    stride = stride_of(length, dtype)
    first, last = start // shard_sequences, (start + n - 1) // shard_sequences
    jvm = spark.sparkContext._jvm
    for shard, where, size in shard_files(spark, path).where(F.col("shard").between(first, last)).orderBy("shard").collect():
        lo = max(start - shard * shard_sequences, 0)
        hi = min(start + n - shard * shard_sequences, size // stride)
        at = jvm.org.apache.hadoop.fs.Path(where)
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        stream.seek(lo * stride)
        for _ in range(lo, hi):
            yield np.frombuffer(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, stride))[:-1], dtype=dtype)
        stream.close()


def _checked(stride: int, shard_sequences: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
            blob = memoryview(content.as_buffer())
            n = len(blob) // stride
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n) + shard * shard_sequences), pa.array([zlib.crc32(blob[i * stride : (i + 1) * stride - 1]) for i in range(n)], pa.int64())], names=["slot", "crc32"]
            )


def stored_sequences(spark: SparkSession, path: str, length: int = SEQUENCE, dtype: str = DTYPE, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """(slot, crc32) of every sequence as it lies in the shard files, by its place in them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(partial(_checked, stride_of(length, dtype), shard_sequences), "slot long, crc32 long")
