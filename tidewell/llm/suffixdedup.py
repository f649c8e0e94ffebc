"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (a smaller id, or the same document and an
earlier start). A document is an id and a text: rows of one id with different texts are documents of their own, in the order of a
hash of the text, which goes with the id through every step. The suffixes in question, cut to ``LENGTH`` bytes, are called windows here. Sorting every window of the corpus is
not needed to sort all that can repeat:

1. Each window has an anchor: the least hash of its ``GRAM``-byte grams. Equal windows have equal anchors. Consecutive windows of
   one anchor are a stretch, whose bytes have a hash. An anchor with one stretch in the corpus holds nothing that repeats.
   Stretches of equal bytes are copies: all but the first repeat as a whole, and only the first goes on ("pre-aggregation").
   What stays open is cut once more by anchors of ``SECOND_GRAM`` bytes, which few windows beside a real repeat share.
2. The windows of stretches that share an anchor but differ (where copies begin and end, mostly) are sorted: every task
   sorts a run, keeps the first of equal windows, front-codes the rest (length of the prefix shared with the window
   before, then the remaining bytes), and sends each range of the order to the task of that range. There the runs are merged by a
   loser tree that carries the known common prefixes along, so no byte that is known to agree is compared again. A window
   that shares all ``LENGTH`` bytes with the one put out before it repeats.
3. What repeats is gathered by document, and the rest of the text is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textarrays import mix64, slices

LENGTH = 100
GRAM, SECOND_GRAM = 32, 80
#: Windows of a stretch at most, of a run at most, and of a range of the merge (expected).
STRETCH = 128
RUN = 400_000
#: Windows (expected) whose run a task makes.
TASK = 250_000
RANGE = 200_000
#: Open pieces (expected) and windows of each that are sampled for the bounds of the ranges.
SAMPLE_PIECES, SAMPLE_WINDOWS = 20_000, 2
_CODE = mix64(np.arange(1001, 1257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, (1 << 20) + 1), _powers(_BACK, (1 << 20) + 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, by doubling (the last step overlaps where that is no power of two)."""
    h, s = _CODE[data], 1
    while s < gram:
        step = min(s, gram - s)
        tail = h[step:]
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (tail ^ (tail >> np.uint64(31)))
        s += step
    return mix64(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (width - s)], h[width - s :]) if width > s else h


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor, hash of the bytes, whether it may repeat itself) of each stretch of a slice."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return (none,) * 6
    grams = length - gram + 1
    hashes = _gram_hashes(data, gram)
    least = _sliding_min(hashes, grams)
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(row_of):
        return (none,) * 6
    firsts = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    start = np.arange(len(row_of)) - firsts[row_of]
    place = offsets[:-1][row_of] + start
    anchor = least[place]
    breaks = np.ones(len(anchor), dtype=bool)
    breaks[1:] = (anchor[1:] != anchor[:-1]) | (row_of[1:] != row_of[:-1])
    opens = np.flatnonzero(breaks)
    counts = np.diff(np.append(opens, len(anchor)))
    if (counts > STRETCH).any():  # periodic text: one anchor over and over
        inner = np.arange(len(anchor)) - np.repeat(opens, counts)
        opens = np.flatnonzero(breaks | (inner % STRETCH == 0))
        counts = np.diff(np.append(opens, len(anchor)))
    rows, starts = row_of[opens], start[opens]
    # two equal windows of one stretch make its bytes periodic: the anchor then begins one window and ends another further on
    begins = np.minimum.reduceat(np.where(hashes[place] == anchor, place, n), opens)
    ends = np.maximum.reduceat(np.where(hashes[place + grams - 1] == anchor, place + grams - 1, -1), opens)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(_BACK, n + 1))
    sums = np.append(np.uint64(0), np.cumsum(_CODE[data] * up[:n], dtype=np.uint64))
    a = offsets[:-1][rows] + starts
    content = mix64((sums[a + counts + length - 1] - sums[a]) * down[a] + counts.astype(np.uint64))
    return rows, starts, counts, anchor[opens].view(np.int64), content.view(np.int64), begins < ends


_STRETCH_FIELDS = "anchor long, content long, doc_id long, text_hash long, base long, at long, seen boolean"


def _seen(anchor: np.ndarray, content: np.ndarray, docs: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a stretch of equal bytes with a smaller place is among those given."""
    order = np.lexsort((starts, texts, docs, anchor, content))
    a, c, d, t, s = anchor[order], content[order], docs[order], texts[order], starts[order]
    head = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(a)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    out = np.empty(len(a), dtype=bool)
    out[order] = (d != d[first]) | (t != t[first]) | (s != s[first])
    return out


def _emit_stretches(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of pieces (doc_id, base: where the piece starts in the document, its bytes).

    Of equal stretches of a slice only the first (all that share its place) can be the first of the corpus, so the others
    are copies already. They go out under an anchor of their own, drawn from their place: an anchor that very many documents share
    then has a few rows a slice. Should such a draw ever meet an anchor in use, that one is open and decided by the merge.
    """
    for batch in batches:
        ids, hashes, bases = (batch[c].to_numpy() for c in ("doc_id", "text_hash", "base"))
        for lo, _, data, offsets in slices(batch["bytes"]):
            rows, starts, counts, anchor, content, periodic = stretches(data, offsets, length, gram)
            base, docs, texts = bases[lo + rows], ids[lo + rows], hashes[lo + rows]
            places = base + starts
            seen = _seen(anchor, content, docs, texts, places)
            own = mix64(mix64(mix64(docs.view(np.uint64)) + texts.view(np.uint64)) + places.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(seen, own, anchor)), pa.array(content), pa.array(docs), pa.array(texts), pa.array(base), pa.array(places * 512 + periodic * 256 + counts), pa.array(seen)],
                names=["anchor", "content", "doc_id", "text_hash", "base", "at", "seen"],
            )


_PIECE_FIELDS = "doc_id long, text_hash long, base long, bytes binary"


def _pieces(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each packed stretch of each text."""
    names, kinds = [f.split()[0] for f in _PIECE_FIELDS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        out = []
        for doc, text_hash, text, ats in zip(*(batch[c] for c in ("doc_id", "text_hash", "text", "ats")), strict=True):
            raw = text.as_py().encode()
            for at in ats.as_py():
                out.append((doc.as_py(), text_hash.as_py(), at // 256, raw[at // 256 : at // 256 + at % 256 + length - 1]))
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
        yield made(out)


def marked_stretches(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, base, at, copy): stretches that copy an earlier one, and such that are open: first of their bytes, but not alone
    with their anchor, or periodic. All others hold nothing that repeats and are left out."""
    found = pieces.mapInArrow(partial(_emit_stretches, length, gram), _STRETCH_FIELDS)
    same_anchor = Window.partitionBy("anchor")
    copies = Window.partitionBy("anchor", "content").orderBy("doc_id", "text_hash", F.expr("at div 512"))
    return (
        found.withColumns({"n": F.rank().over(copies), "lo": F.min("content").over(same_anchor), "hi": F.max("content").over(same_anchor)})
        .where("seen or n > 1 or lo <> hi or at % 512 >= 256")
        .select("doc_id", "text_hash", "base", F.expr("at div 512 * 256 + at % 256").alias("at"), F.expr("seen or n > 1").alias("copy"))
    )


def _windows(piece: bytes, base: int, ats: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the document, windows as rows of bytes) of the packed stretches of one piece."""
    starts = np.unique(np.concatenate([np.arange(x // 256, x // 256 + x % 256) for x in ats]))
    data = np.frombuffer(piece, dtype=np.uint8)
    return starts, np.lib.stride_tricks.sliding_window_view(data, length)[starts - base]


def _sample(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for base, piece, ats in zip(batch["base"], batch["bytes"], batch["ats"], strict=True):
            starts, rows = _windows(piece.as_py(), base.as_py(), ats.as_py(), length)
            step = max(1, len(starts) // SAMPLE_WINDOWS)
            out += [x.tobytes() for x in rows[::step][:SAMPLE_WINDOWS]]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])


def _front_coded(part: int, rows: np.ndarray, shared: np.ndarray, places: np.ndarray, again: np.ndarray) -> list:
    """One run of one range: prefix lengths (the first starts anew), the remaining bytes end to end, and places."""
    shared = shared.copy()
    shared[:1] = 0
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return [part, shared.astype(np.uint8).tobytes(), rest.tobytes(), places.tobytes(), again.tobytes()]


_RUN_FIELDS = "part int, shared binary, rest binary, places binary, again binary"


def _runs(length: int, bounds: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs, cut at the bounds of the ranges. A place is (document, hash of its text, start)."""
    cut_at = np.array(bounds, dtype=f"S{length}")
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        places, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort(places.T[::-1])
        places, rows = places[order], np.ascontiguousarray(rows[order])
        order = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
        places, rows = places[order], rows[order]
        same = rows[1:] == rows[:-1]
        shared = np.concatenate([[0], np.where(same.all(1), length, same.argmin(1))])
        again = shared == length
        # the first of equal windows stays; the others repeat it, unless they are the very same place
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
        true_dup = again & (places != places[head]).any(1)
        parts = np.searchsorted(cut_at, rows.view(f"S{length}").ravel(), "right")
        # prefix shared with the window kept before: nothing is lost by dropping equal ones in between
        out = []
        for part in np.unique(parts):
            own = parts == part
            k, d = own & ~again, own & true_dup
            out.append(_front_coded(int(part), rows[k], shared[k], places[k], places[d]))
        names = [f.split()[0] for f in _RUN_FIELDS.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    n = 0
    for batch in batches:
        for doc, text, base, piece, ats in zip(*(batch[c] for c in ("doc_id", "text_hash", "base", "bytes", "ats")), strict=True):
            starts, rows = _windows(piece.as_py(), base.as_py(), ats.as_py(), length)
            places = np.empty((len(starts), 3), dtype=np.int64)
            places[:, 0], places[:, 1], places[:, 2] = doc.as_py(), text.as_py(), starts
            held.append((places, rows))
            n += len(starts)
            if n >= RUN:
                yield flush()
                n = 0
    if held:
        yield flush()


Head = tuple[bytes, int, tuple[int, int, int]]


def _decoded(shared: bytes, rest: bytes, places: bytes, length: int) -> Iterator[Head]:
    """(window, prefix shared with the one before, place) of a front-coded run, one at a time."""
    last, at = b"", 0
    for h, (doc, text, start) in zip(shared, np.frombuffer(places, np.int64).reshape(-1, 3), strict=True):
        last = last[:h] + rest[at : at + length - h]
        at += length - h
        yield last, h, (int(doc), int(text), int(start))


def merge_runs(runs: list[Iterator[Head]], length: int = LENGTH) -> Iterator[tuple[int, tuple, bytes]]:
    """(prefix shared with the window before, place, window) in order of (window, place), by a loser tree.

    A run's head carries the length of the prefix it shares with the last window put out. Of two heads the one with the
    longer such prefix is the lesser, unseen bytes are compared only where both are equal, and what that comparison
    finds is the loser's prefix from then on. A run's next window brings its front-coded prefix: its
    predecessor in the run was the last one put out. Only the heads are unpacked.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    known = [0] * size  # prefix of each run's head shared with the last output
    first = [next(r, None) for r in runs] + [None] * (size - k)
    head: list = [x and x[0] for x in first]
    place: list = [x and x[2] for x in first]
    tree = [0] * size  # losers, by inner node

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, g = known[a], known[b]
        if h > g:
            return a, b
        if g > h:
            return b, a
        while h < length and x[h] == y[h]:
            h += 1
        before = place[a] <= place[b] if h == length else x[h] < y[h]
        if before:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lo = play(level[i], level[i + 1])
            tree[node + i // 2] = lo
            nxt.append(w)
        level = nxt
    w = level[0]
    while head[w] is not None:
        yield known[w], place[w], head[w]
        head[w], known[w], place[w] = next(runs[w], (None, 0, None))
        node = (w + size) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2


_CUT_FIELDS = "doc_id long, text_hash long, at long"


def _merge(length: int, table: pa.Table) -> pa.Table:
    again, runs = [], []
    for row in table.to_pylist():
        again.append(np.frombuffer(row["again"], np.int64).reshape(-1, 3))
        if row["shared"]:
            runs.append(_decoded(row["shared"], row["rest"], row["places"], length))
    more: list[tuple] = []
    first = None
    if len(runs) > 1:  # a single run has put its repeats aside by itself
        for shared, place, _ in merge_runs(runs, length):
            if shared < length:
                first = place
            elif place != first:
                more.append(place)
    places = np.concatenate([*again, np.array(more, dtype=np.int64).reshape(-1, 3)])
    places = places[np.lexsort(places.T[::-1])]
    # windows in a row of one document become one stretch again
    opens = np.flatnonzero(np.append(True, (places[1:] != places[:-1] + [0, 0, 1]).any(1))) if len(places) else np.zeros(0, np.int64)
    counts = np.diff(np.append(opens, len(places)))
    pieces = [(*places[o].tolist(), j, min(255, c - j)) for o, c in zip(opens.tolist(), counts.tolist(), strict=True) for j in range(0, c, 255)]
    columns = [[x[0] for x in pieces], [x[1] for x in pieces], [(x[2] + x[3]) * 256 + x[4] for x in pieces]]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("doc_id", "text_hash", "at"), columns, strict=True)})


def _cut(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, removed, spans, shas, kept_texts = [], [], [], [], []
        for text, ats in zip(batch["text"], batch["ats"], strict=True):
            raw = (text.as_py() or "").encode()
            marks = np.zeros(len(raw) + 1, dtype=np.int64)
            if ats.is_valid:
                at = np.array(ats.as_py(), dtype=np.int64)
                np.add.at(marks, at // 256, 1)
                np.add.at(marks, at // 256 + at % 256 + length - 1, -1)
            gone = np.cumsum(marks[:-1]) > 0
            rest = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if gone.any() else raw
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(rest))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(["kept"])


def _cut_digest(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _narrow(_cut(length, batches))


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per document, what is left after the cut.

    Strings are bytes of UTF-8 and are judged on the input. Null and empty texts have no bytes; texts below ``length``
    bytes are kept whole; rows of one id and text are the same document, so they do not repeat each other; rows of one id with
    different texts are documents of their own; rows of a null id
    have no place in the order, so they are kept whole and nothing repeats them; a very long text is read in
    one piece by one task; periodic texts are cut after their first ``length`` bytes and period; an empty table gives an
    empty result; other columns are not read.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    place = ["doc_id", "text_hash"]
    whole = texts.where("text is not null and doc_id is not null").select(*place, F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("bytes"))
    marked = written(marked_stretches(whole, length, GRAM), "repeats-stretches")
    parts = [marked.where("copy").select(*place, "at")]
    open_ = marked.where("not copy").groupBy(*place).agg(F.collect_set("at").alias("ats"))
    pieces = written(texts.join(open_, place).select(*place, "text", "ats").mapInArrow(partial(_pieces, length), _PIECE_FIELDS).distinct(), "repeats-pieces")
    again = written(marked_stretches(pieces, length, SECOND_GRAM), "repeats-stretches")
    parts.append(again.where("copy").select(*place, "at"))
    left_over = again.where("not copy")
    windows = left_over.agg(F.sum(F.col("at") % 256)).first()[0] or 0
    open_ = left_over.groupBy(*place, "base").agg(F.collect_set("at").alias("ats"))
    # tasks of so many windows, however well their bytes pack
    left = pieces.join(open_, [*place, "base"]).repartition(max(1, -(-windows // TASK)), *place, "base")
    left = written(left.select(*place, "base", "bytes", "ats"), "repeats-open", pieces)
    n_pieces = left.count()
    if n_pieces:
        few = left.where(F.pmod(F.xxhash64(*place, "base"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_PIECES / n_pieces)) + 1)
        sample = sorted(bytes(r[0]) for r in few.select("base", "bytes", "ats").mapInArrow(partial(_sample, length), "w binary").collect())
        n_ranges = max(1, min(-(-windows // RANGE), len(sample)))
        bounds = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)]
        runs = left.select(*place, "base", "bytes", "ats").mapInArrow(partial(_runs, length, bounds), _RUN_FIELDS)

        def merge(table: pa.Table) -> pa.Table:
            return _merge(length, table)

        parts.append(runs.groupBy("part").applyInArrow(merge, _CUT_FIELDS))
    every = reduce(DataFrame.union, parts)
    cuts = written(every.groupBy(*place).agg(F.collect_list("at").alias("ats")), "repeats-cuts")
    both = texts.join(cuts, place, "left").select("doc_id", "text", "ats")
    if with_text:
        return both.mapInArrow(partial(_cut, length), _DIGEST + ", kept binary")
    return both.mapInArrow(partial(_cut_digest, length), _DIGEST)
