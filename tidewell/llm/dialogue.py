"""Repair of conversations by cheapest edits, with block tables after the method of the Four Russians.

The rows of a conversation become a string of symbols (may it stay, whose turn is it, does it break off). The cheapest edits
that make its roles follow ``(s?(ua)+)?`` come from a shortest path over four states; ``cost to go`` vectors over these states,
less their minimum, take few values. For every block of ``WIDTH`` symbols and every such vector behind it, tables hold the vector
before the block, what was taken off it, and the state in which a trace leaves the block. A conversation is read from its
end by one lookup a block; then the blocks are expanded from the vectors kept between them, and the trace goes
forward through them by the least letter that is on a cheapest path, which gives the least of all cheapest audits.

Rows are sorted by ranges of (conversation, turn), so a conversation of any length is many tasks. One that lies within a
range is repaired at once. One that crosses an edge, or is longer than a chunk, is taken in chunks of bounded size: what a chunk
does to every vector and every state is a small table, these tables are chained by conversation, and each chunk is traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .storage import written

#: Symbols of a block, and rows and characters of a chunk.
WIDTH = 4
CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20

#: Costs of the edits; Keep costs nothing.
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Symbols: 0 must go, 1 + 2 * kind + truncated, the last one stands for no row.
KINDS = "sua"
NEXT = (2, 2, 3, 2)  # the state after the only letter that may be put in
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NO_ROW = 9
N_SYMBOLS = 10
ALLOWED = {"su", "ua", "au"}
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def symbol(role: str, truncated: bool) -> int:
    kind = KINDS.find(role[:1]) if role else -1
    return 1 + 2 * (kind if kind >= 0 else 3) + truncated


def _moves(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a symbol, in the order of their letters."""
    yield "D", DELETE, state
    if sym:
        kind, broken = (sym - 1) // 2, (sym - 1) % 2 * BROKEN
        if kind < 3 and (state, KINDS[kind]) in AFTER:
            yield "K", broken, AFTER[state, KINDS[kind]]
        yield "R", REROLE + broken, NEXT[state]


def _inserted(vector: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        vector = [min(c, INSERT + vector[NEXT[q]]) for q, c in enumerate(vector)]
    return tuple(vector)


def _before(sym: int, vector: tuple[int, ...]) -> tuple[int, ...]:
    """The cost-to-go vector before a symbol, from the one after it."""
    if sym == NO_ROW:
        return vector
    return _inserted([min(cost + vector[to] for _, cost, to in _moves(sym, q)) for q in range(4)])


END = _inserted([0, 99, 99, 0])


def _trace(sym: int, vector: tuple[int, ...], state: int) -> tuple[str, int]:
    """(edits, state after them) of the least cheapest way over one symbol; an insertion is ``U`` or ``A``, a new role ``u`` or ``a``."""
    if sym == NO_ROW:
        return "", state
    before, out = _before(sym, vector), ""
    while True:
        left = before[state]
        options = {letter: (cost, to) for letter, cost, to in _moves(sym, state)}
        if options["D"][0] + vector[state] == left:
            return out + "D", state
        if INSERT + before[NEXT[state]] == left:
            state = NEXT[state]
            out += " UA"[state - 1]
            continue
        letter = "K" if "K" in options and options["K"][0] + vector[options["K"][1]] == left else "R"
        to = options[letter][1]
        return out + (letter if letter == "K" else " ua"[to - 1]), to


def _tail(state: int) -> str:
    """Insertions after the last row."""
    out = ""
    while END[state]:
        state = NEXT[state]
        out += " UA"[state - 1]
    return out


LETTERS = str.maketrans("uaUA", "RRII")


@dataclass
class Tables:
    """``before``, ``taken`` (block, vector) and ``leaves`` (block, vector, state), and the vectors by number."""

    vectors: list[tuple[int, ...]]
    before: np.ndarray
    taken: np.ndarray
    leaves: np.ndarray
    expanded: dict[tuple[int, int, int], str] = field(default_factory=dict)

    def expand(self, block: int, vector: int, state: int) -> str:
        """The edits of a block, from the vector behind it and the state before it."""
        key = (block, vector, state)
        if key not in self.expanded:
            syms = [block // N_SYMBOLS ** (WIDTH - 1 - i) % N_SYMBOLS for i in range(WIDTH)]
            behind = [self.vectors[vector]]
            for sym in reversed(syms[1:]):  # backward through the block, then forward by the least letter
                behind.append(_before(sym, behind[-1]))
            out = ""
            for sym, after in zip(syms, reversed(behind), strict=True):
                edits, state = _trace(sym, after, state)
                out += edits
            self.expanded[key] = out
        return self.expanded[key]


@cache
def tables() -> Tables:
    """Made once a process: the vectors that can occur, one symbol's tables, and those of blocks by putting symbols in front."""
    numbers, vectors = {END: 0}, [END]
    step, taken = [], []
    for vector in vectors:  # grows while it is read
        row, less = [], []
        for sym in range(N_SYMBOLS):
            made = _before(sym, vector)
            low = min(made)
            made = tuple(c - low for c in made)
            if made not in numbers:
                numbers[made] = len(vectors)
                vectors.append(made)
            row.append(numbers[made])
            less.append(low)
        step.append(row)
        taken.append(less)
    one, low = np.array(step).T, np.array(taken).T
    leave = np.array([[[_trace(sym, v, q)[1] for q in range(4)] for v in vectors] for sym in range(N_SYMBOLS)])
    before, less, leaves = one, low, leave
    for _ in range(WIDTH - 1):
        v = before[None]  # (1, blocks, vectors)
        sym = np.arange(N_SYMBOLS)[:, None, None]
        less = less[None] + low[sym, v]
        here = leave[sym, v]  # (symbols, blocks, vectors, states)
        leaves = leaves[np.arange(before.shape[0])[None, :, None, None], np.arange(len(vectors))[None, None, :, None], here]
        before = one[sym, v].reshape(-1, len(vectors))
        less, leaves = less.reshape(-1, len(vectors)), leaves.reshape(-1, len(vectors), 4)
    return Tables(vectors, before.astype(np.int32), less.astype(np.int32), leaves.astype(np.int8))


def blocks(symbols: bytes) -> list[int]:
    syms = np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
    syms = np.append(syms, np.full(-len(syms) % WIDTH, NO_ROW, dtype=np.int64)).reshape(-1, WIDTH)
    return (syms @ N_SYMBOLS ** np.arange(WIDTH - 1, -1, -1)).tolist()


def repair(symbols: bytes, vector: int = 0, state: int = 0) -> tuple[int, str, int]:
    """(cost, edits, state after them) from the vector behind the rows and the state before them; without what may come after."""
    t = tables()
    chain, cost = [], 0
    for block in reversed(blocks(symbols)):
        chain.append((block, vector))
        cost += int(t.taken[block, vector])
        vector = int(t.before[block, vector])
    cost += t.vectors[vector][state]
    edits = []
    for block, behind in reversed(chain):
        edits.append(t.expand(block, behind, state))
        state = int(t.leaves[block, behind, state])
    return cost, "".join(edits), state


def effect(symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rows do to every vector behind them and every state before them: (vector before, taken off, state after)."""
    t = tables()
    n = len(t.vectors)
    vector, taken, leaves = np.arange(n), np.zeros(n, dtype=np.int64), np.tile(np.arange(4), (n, 1))
    for block in reversed(blocks(symbols)):
        leaves = np.take_along_axis(leaves, t.leaves[block, vector].astype(np.int64), 1)
        taken += t.taken[block, vector]
        vector = t.before[block, vector]
    return vector, taken, leaves


ROLE_OF = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def repaired(edits: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of what the edits leave and put in."""
    out, at = [], 0
    for e in edits:
        if e in "UA":
            out.append(f"{ROLE_OF[e]}:")
            continue
        if e != "D":
            out.append(f"{roles[at] if e == 'K' else ROLE_OF[e]}:{texts[at]}")
        at += 1
    return out


@dataclass
class Rows:
    """Rows of one conversation, or of a part of it, in order."""

    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def faults(self) -> tuple[bytes, list[bytes], dict[str, int]]:
        """(symbols, digests of the rows that may stay, counts)."""
        seen: set[bytes] = set()
        symbols, digests = bytearray(), []
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        for role, text in zip(self.roles, self.texts, strict=True):
            bare = text.rstrip(BLANK)
            if not bare:
                n["blank"] += 1
                symbols.append(0)
                continue
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if digest in seen:
                n["duplicate"] += 1
                symbols.append(0)
                continue
            seen.add(digest)
            digests.append(digest)
            truncated = bare[-1] not in ".!?"
            n["truncated"] += truncated
            symbols.append(symbol(role, truncated))
        initials = [r[:1] for r in self.roles]
        n["illegal"] = sum(a + b not in ALLOWED for a, b in zip(initials, initials[1:], strict=False))
        return bytes(symbols), digests, n

    def span(self) -> tuple[int | None, int | None, int]:
        known = {t for t in self.turns if t is not None}
        return (min(known), max(known), len(known)) if known else (None, None, 0)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
CHUNK = (
    "part int, seq int, symbols binary, digests array<binary>, blank long, duplicate long, truncated long, illegal long, "
    "least long, most long, turns long, head string, foot string, roles array<string>, texts array<string>"
)
CHUNK_NAMES = [f.split()[0] for f in CHUNK.split(", ")]
PLACE = ["conv", "part", "seq"]


def _whole(rows: Rows) -> dict:
    symbols, _, n = rows.faults()
    least, most, turns = rows.span()
    cost, edits, state = repair(symbols)
    edits += _tail(state)
    body = "\n".join(repaired(edits, rows.roles, rows.texts))
    gaps = most - least + 1 - turns if turns else 0
    return n | {"gaps": gaps, "cost": cost, "audit": edits.translate(LETTERS), "repaired_sha256": hashlib.sha256(body.encode()).hexdigest()}


def _part(rows: Rows, part: int, seq: int) -> dict:
    symbols, digests, n = rows.faults()
    least, most, turns = rows.span()
    ends = {"head": rows.roles[0][:1], "foot": rows.roles[-1][:1]} if rows.roles else {"head": None, "foot": None}
    return n | ends | {"part": part, "seq": seq, "symbols": symbols, "digests": digests, "least": least, "most": most, "turns": turns, "roles": rows.roles, "texts": rows.texts}


def _repair_sorted(names: list[str], types: list[pa.DataType], chunk_rows: int, chunk_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: conversations that lie within the range repaired, others as chunks."""
    part, rows, seq = TaskContext.get().partitionId(), Rows(), 0
    at_edge, any_row, now = True, False, None
    made: list[dict] = []

    def close(conv, last: bool) -> None:
        made.append({"conv_id": conv} | (_part(rows, part, seq) if at_edge or last or seq else _whole(rows)))

    def batch_of(rows_: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows_], t) for c, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if any_row and conv != now:
                close(now, False)
                at_edge, rows, seq = False, Rows(), 0
            any_row, now = True, conv
            if text is not None:  # else the row only names its conversation
                if len(rows.turns) >= chunk_rows or (rows.turns and rows.chars + len(text) > chunk_chars):
                    made.append({"conv_id": now} | _part(rows, part, seq))
                    rows, seq = Rows(), seq + 1
                rows.add(turn, role, text)
            if len(made) >= 1000 or (made and "texts" in made[-1] and made[-1]["texts"]):
                yield batch_of(made)
                made = []
    if any_row:
        close(now, True)
    if made:
        yield batch_of(made)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the rows struck out that an earlier chunk has; counts corrected; their effect as bytes."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        out = {n: [] for n in ("symbols", "duplicate", "truncated", "before", "taken", "leaves")}
        for symbols, digests, earlier, dup, cut in zip(cols["symbols"], cols["digests"], cols["earlier"], cols["duplicate"], cols["truncated"], strict=True):
            struck, which = set(earlier or ()), iter(digests)
            syms = bytearray(symbols)
            for i, s in enumerate(syms):
                if s and next(which) in struck:
                    dup, cut, syms[i] = dup + 1, cut - (s - 1) % 2, 0
            before, taken, leaves = effect(bytes(syms))
            for n, v in zip(out, (bytes(syms), dup, cut, before.astype(np.int32).tobytes(), taken.astype(np.int64).tobytes(), leaves.astype(np.int8).tobytes()), strict=True):
                out[n].append(v)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=[*PLACE, *out])


EFFECTS = "conv string, part int, seq int, symbols binary, duplicate long, truncated long, before binary, taken binary, leaves binary"


def _chain_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last chunk of each conversation to the first: the vector behind each, what is taken off there, the states it leaves in."""
    conv, vector = None, 0
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("conv", "before", "taken", "leaves")]
        behind, taken, leaves, low = [], [], [], []
        for c, b, t, x in zip(*cols, strict=True):
            if c != conv:
                conv, vector = c, 0
            behind.append(vector)
            taken.append(int(np.frombuffer(t, dtype=np.int64)[vector]))
            leaves.append(x[4 * vector : 4 * vector + 4])
            vector = int(np.frombuffer(b, dtype=np.int32)[vector])
            low.append(tables().vectors[vector][0])
        made = [pa.array(behind, pa.int32()), pa.array(taken, pa.int64()), pa.array(leaves, pa.binary()), pa.array(low, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*PLACE, "symbols", "duplicate", "truncated")), *made], names=[*PLACE, "symbols", "duplicate", "truncated", "behind", "taken", "leaves", "low"])


def _chain_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first chunk to the last: the state before each, and the cost, whole in a conversation's first chunk."""
    conv, state = None, 0
    for batch in batches:
        before, cost = [], []
        for c, x, t, low in zip(*(batch.column(n).to_pylist() for n in ("conv", "leaves", "taken", "low")), strict=True):
            first = c != conv
            conv, state = c, 0 if first else state
            before.append(state)
            cost.append(t + (low if first else 0))
            state = x[state]
        kept = [*PLACE, "symbols", "duplicate", "truncated", "behind"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(before, pa.int32()), pa.array(cost, pa.int64())], names=[*kept, "state", "cost"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's part of the audit and of the repaired text, and the state after it."""
    for batch in batches:
        audits, bodies, states = [], [], []
        for symbols, behind, state, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("symbols", "behind", "state", "roles", "texts")), strict=True):
            _, edits, state = repair(symbols, behind, state)
            audits.append(edits.translate(LETTERS))
            bodies.append("\n".join(repaired(edits, roles, texts)))
            states.append(state)
        kept = [i for i, n in enumerate(batch.schema.names) if n not in ("symbols", "behind", "state", "roles", "texts")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(audits, pa.string()), pa.array(bodies, pa.string()), pa.array(states, pa.int32())],
            names=[*(batch.schema.names[i] for i in kept), "audit", "body", "state"],
        )


PIECES = (
    "conv string, part int, seq int, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, head string, foot string, cost long, audit string, body string, state int"
)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, a conversation at a time: only its digest, counts and audit are held."""
    out: list[dict] = []
    now = None

    def close() -> dict:
        tail = _tail(now["state"])
        for line in repaired(tail, [], []):
            now["sha"].update(("\n" if now["lines"] else "").encode() + line.encode())
            now["lines"] = True
        gaps = now["most"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
        audit = "".join(now["audit"]) + tail.translate(LETTERS)
        return {c: now[c] for c in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": audit, "repaired_sha256": now["sha"].hexdigest()}

    def batch_of() -> pa.RecordBatch:
        names = ["conv", *COUNTS, "audit", "repaired_sha256"]
        kinds = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        for p in (dict(zip(batch.schema.names, row, strict=True)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if now is None or p["conv"] != now["conv"]:
                if now:
                    out.append(close())
                now = {"conv": p["conv"], "sha": hashlib.sha256(), "lines": False, "audit": [], "least": None, "most": None, "turns": 0, "foot": None}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += p[c]
            if p["head"] is not None:
                now["illegal"] += now["foot"] is not None and now["foot"] + p["head"] not in ALLOWED
                now["foot"] = p["foot"]
            if p["turns"]:
                now["turns"] += p["turns"] - (now["most"] == p["least"])
                now["least"] = p["least"] if now["least"] is None else now["least"]
                now["most"] = p["most"]
            if p["body"]:
                now["sha"].update(("\n" if now["lines"] else "").encode() + p["body"].encode())
                now["lines"] = True
            now["audit"].append(p["audit"])
            now["state"] = p["state"]
        if out:
            yield batch_of()
            out.clear()
    if now:
        out.append(close())
        yield batch_of()


def _name(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("="), conv.cast("string")))


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row a conversation: ``conv_id``, counts of faults, and the digests of its cheapest repair.

    ``gone``: a boolean column; such a row only names its conversation. The order is by turn (nulls first); rows of one turn
    follow by role, by the first 64 characters of their text and a hash of it. Null roles and texts are one space, a null id is a
    conversation. Blank: no character but ASCII white space; duplicate: role and text seen earlier; truncated: the last such
    character is not ``.``, ``!`` or ``?``; of these the first counts. Empty texts are blank; repeated rows are duplicates;
    texts of any length are read whole; columns but the named ones are not read. A conversation without rows has zeros, an
    empty audit and the digest of nothing; an empty table has none.
    """
    kept = F.lit(True) if gone is None else ~F.coalesce(F.col(gone), F.lit(False))
    narrow = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.when(kept, F.coalesce(F.col(text), F.lit(" "))).alias("text"),
    ).withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_id": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "_head", "_hash", "_id")]  # equal rows of any number are parted by the id
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    kind = placed.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {RESULT}, " + ", ".join(f for f in CHUNK.split(", ") if f.split()[0] not in COUNTS)
    fields = rows.sparkSession.createDataFrame([], schema).schema
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]
    first = written(placed.mapInArrow(partial(_repair_sorted, names, types, chunk_rows, chunk_chars), fields), "dialogue-chunks")
    result = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    done = first.where("part is null").select(result)
    chunks = first.where("part is not null").withColumn("conv", _name(F.col("conv_id")))

    # rows whose like an earlier chunk of the conversation has
    marks = chunks.select(*PLACE, F.explode("digests").alias("digest"))
    earliest = marks.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = marks.join(earliest, ["conv", "digest"]).where(F.struct("part", "seq") > F.col("first"))
    earlier = later.groupBy(*PLACE).agg(F.collect_list("digest").alias("earlier"))
    slim = chunks.select(*PLACE, "symbols", "digests", "duplicate", "truncated").join(earlier, PLACE, "left")
    effects = written(slim.mapInArrow(_effects, EFFECTS), "dialogue-effects")

    back = effects.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    back = written(back.mapInArrow(_chain_back, "conv string, part int, seq int, symbols binary, duplicate long, truncated long, behind int, taken long, leaves binary, low long"), "dialogue-back", effects)
    on = back.repartition("conv").sortWithinPartitions(*PLACE)
    on = on.mapInArrow(_chain_on, "conv string, part int, seq int, symbols binary, duplicate long, truncated long, behind int, state int, cost long")
    both = chunks.select(*PLACE, "blank", "illegal", "least", "most", "turns", "head", "foot", "roles", "texts").join(on, PLACE)
    order = [f.split()[0] for f in PIECES.split(", ")]
    pieces = both.select(*[c for c in order if c in both.columns], "symbols", "behind", "roles", "texts").mapInArrow(_pieces, PIECES)
    pieces = pieces.repartition("conv").sortWithinPartitions(*PLACE)
    joined = pieces.mapInArrow(_joined, f"conv string, {RESULT}")
    ids = chunks.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    return done.unionByName(joined.join(ids, "conv").select(result))
