"""Conversation structure repair by a time-major dynamic program over tensors.

A repaired conversation's role initials are `(s?(ua)+)?`. Four states say what stands last: nothing, s, u or a. Edits: Keep 0,
Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate rows), Insert an empty user or assistant row 2; an
undeleted truncated row adds 1. Of the cheapest edits those with the ASCII-least initials (D, I, K, R) are taken.

1. thin(): a row for each distinct (conversation, turn, role, text digest) with its number of copies and its faults. A text's
   first occurrence is an aggregate; rows learn whether they are it by a join on keys that are unique.
2. ordered(): thin rows sorted by ranges, so a long conversation lies in many of them, cut into blocks of BLOCK rows. What of
   a conversation stands in one block is a piece.
3. In a block, pieces are cut into chunks of CHUNK rows and bucketed by length; states' costs of all chunks of a bucket are
   updated together, turn by turn from the back, and kept. Edits are traced forwards the same way.
4. Only a block's first and last piece can belong to conversations in several blocks. Those pieces' cost matrices (cheapest way
   from each state to each) are chained from the back, which gives what follows each piece costs; then each is traced from each
   state, and the states are chained from the front. A chain has a row per block.
5. Texts are moved once, to their conversation, where they meet its edits in order; rows stream through, and digests with them.

Rows: conv_id, turn, role, text. Nulls in what is digested or compared are one space; a null conv_id is a conversation of its own; rows
of a null turn come first; rows of the same turn stand in the order of role and text digest (SHA-256), equal rows are duplicates.
Initials are the role's first character; roles other than s.., u.., a.. can't be kept. No rows: none. Other columns don't matter. A
SHA-256 can't be worked out in parts, so one task streams a whole conversation's texts; it holds its audit, a letter per edit, and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, kept, prepare, shared_dir

#: Rows of a block (a power of two), and of a chunk within it.
BLOCK, CHUNK = 1 << 16, 256
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE = 0, 1, 2
BLANK, REPEAT, TRUNCATED = 1, 2, 4
FAR = 1 << 40
#: States: 0 nothing, 1 s, 2 u, 3 a. Where an inserted or reroled row leads; where keeping s, u, a, other leads (4: nowhere).
ROLES, NEXT = ("user", "user", "assistant", "user"), np.array([2, 2, 3, 2])
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: What ending costs: from u an assistant, from s both.
ENDING = np.array([0, 4, 2, 0])
SCHEMA = "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """c, known, turn, role, text, copies (0: dropped) of conversation rows; c is '' for a null conv_id, known tells null turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("kind")
    cut = F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), text("role").alias("role"), text("text").alias("text"), kind)
    return rows.select("c", "known", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def thin(rows: DataFrame) -> DataFrame:
    """c, known, turn, role, digest, initial, fault of each distinct row that damage left."""
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    first = F.left("role", F.lit(1))
    one = rows.filter("copies > 0").select("c", "known", "turn", "role", "digest", F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"), fault.alias("fault"))
    return one.distinct()


def with_repeats(rows: DataFrame) -> DataFrame:
    """thin rows, fault REPEAT where role and text stood earlier in the conversation (blank rows stay blank)."""
    first = rows.groupBy("c", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("at")).select("c", "role", "digest", "at.*", F.lit(True).alias("first"))
    fault = F.when(F.col("first").isNull() & (F.col("fault") != BLANK), REPEAT).otherwise(F.col("fault"))
    return rows.join(first, ["c", "role", "digest", "known", "turn"], "left").withColumn("fault", fault).drop("first")


def chunks_of(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and piece of each chunk of the pieces, in order."""
    n = -(-lengths // CHUNK)
    piece = np.repeat(np.arange(len(starts)), n)
    at = (np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)) * CHUNK
    return starts[piece] + at, np.minimum(CHUNK, lengths[piece] - at), piece


def buckets(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Steps, and the chunks of at most so many rows, by powers of two."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size):
        some = np.flatnonzero(size == s)
        yield int(lengths[some].max()), some


def choices(initial: np.ndarray, fault: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Delete, Keep and Rerole of one row cost from each state (rows by states), by what follows costs."""
    more = np.where(fault == 0, 0, np.where(fault == TRUNCATED, 1, FAR))[:, None]
    wide = np.concatenate([after, np.full((len(after), 1), FAR)], 1)
    return after + 3, np.take_along_axis(wide, KEPT[initial], 1) + more, after[:, NEXT] + 2 + more


def backward(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Time-major costs of all chunks of a bucket (steps + 1, chunks, states): from a state before a step to the chunk's end."""
    costs = np.empty((len(initial) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(initial) - 1, -1, -1):
        best = np.minimum.reduce(choices(initial[t], fault[t], costs[t + 1]))
        u, a = np.minimum(best[:, 2], best[:, 3] + 2), np.minimum(best[:, 3], best[:, 2] + 2)  # rows may be inserted first
        now = np.stack([np.minimum(best[:, 0], u + 2), np.minimum(best[:, 1], u + 2), u, a], 1)
        costs[t] = np.where((t < length)[:, None], now, end)
    return costs


def trace(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits of each step and chunk (edit + 4 * rows inserted before it), and the states at the ends; state: those at the starts."""
    lane, edits = np.arange(len(state)), np.zeros(initial.shape, np.uint8)
    for t in range(len(initial)):
        delete, keep, _ = choices(initial[t], fault[t], costs[t + 1])
        open_ = t < length
        for _ in range(2):
            now = costs[t][lane, state]
            insert = open_ & (now != delete[lane, state]) & (now == costs[t][lane, NEXT[state]] + 2)
            if not insert.any():
                break
            edits[t] += 4 * insert.astype(np.uint8)
            state = np.where(insert, NEXT[state], state)
        now = costs[t][lane, state]
        drop = now == delete[lane, state]
        stay = ~drop & (now == keep[lane, state])
        edits[t] += np.where(drop, DELETE, np.where(stay, KEEP, REROLE)).astype(np.uint8)
        after = np.where(drop, state, np.where(stay, KEPT[initial[t], state], NEXT[state]))
        state = np.where(open_, after, state)
    return edits, state


def grid(values: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """values of chunks, a row for each step; what stands beyond a chunk isn't used."""
    return values[np.minimum(starts[None, :] + np.arange(steps)[:, None], len(values) - 1)]


def matrices(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The cheapest cost from each state to each of every chunk (chunks, from, to)."""
    out = np.empty((len(starts), 4, 4), np.int64)
    for steps, some in buckets(lengths):
        x, f = (np.repeat(grid(v, starts[some], steps), 4, 1) for v in (initial, fault))
        end = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(some), 1))
        out[some] = backward(x, f, np.repeat(lengths[some], 4), end)[0].reshape(len(some), 4, 4).transpose(0, 2, 1)
    return np.minimum(out, FAR)


def before(m: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs before a chunk of matrix m, by those after it (a vector, or a matrix of them)."""
    return np.minimum((m[:, :, None] + (after if after.ndim > 1 else after[:, None])[None]).min(1), FAR).reshape(after.shape)


def solved(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits (rows, by state at the piece's start) and end states (pieces, by state at the start) of pieces; ends: what follows each costs."""
    at, size, piece = chunks_of(starts, lengths)
    end = ends[piece]
    several = np.flatnonzero(piece[:-1] == piece[1:])  # chunks that another of their piece follows
    m = matrices(initial, fault, at, size) if len(several) else None
    for i in several[::-1]:
        end[i] = before(m[i + 1], end[i + 1])
    edits, leads = np.zeros((len(initial), 4), np.uint8), np.empty((len(at), 4), np.int64)
    for steps, some in buckets(size):
        x, f = grid(initial, at[some], steps), grid(fault, at[some], steps)
        costs = backward(x, f, size[some], end[some])
        inside = np.arange(steps)[:, None] < size[some]
        rows = (at[some] + np.arange(steps)[:, None])[inside]
        for state in range(4):
            got, leads[some, state] = trace(x, f, size[some], costs, np.full(len(some), state))
            edits[rows, state] = got[inside]
    # Chunks were traced from each state: the state at a piece's start picks one of them for each chunk.
    out, reached = edits.copy(), leads.copy()
    for i in several:
        out[at[i + 1] : at[i + 1] + size[i + 1]] = edits[at[i + 1] : at[i + 1] + size[i + 1]][:, reached[i]]
        reached[i + 1] = leads[i + 1][reached[i]]
    return out, reached[np.flatnonzero(np.append(piece[:-1] != piece[1:], True))]


def pieces_in(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """A block's rows in order; start, length and conversation of each piece; initials and faults."""
    t = t.sort_by("pos")
    c = t.column("c").combine_chunks()
    new = np.ones(len(c), bool)
    new[1:] = pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    x, f = (t.column(n).to_numpy().astype(np.int64) for n in ("initial", "fault"))
    return t, starts, np.diff(np.append(starts, len(c))), c.take(pa.array(starts)).to_pylist(), x, f


def edge_matrices(t: pa.Table) -> pa.Table:
    """block, c, m of a block's first and last piece."""
    t, starts, lengths, names, x, f = pieces_in(t)
    out = []
    for k in sorted({0, len(starts) - 1}):
        at, size, _ = chunks_of(starts[k : k + 1], lengths[k : k + 1])
        m = matrices(x, f, at, size)
        whole = m[-1]
        for one in m[-2::-1]:
            whole = before(one, whole)
        out.append({"block": t.column("block")[0].as_py(), "c": names[k], "m": whole.ravel().tolist()})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("c", pa.string()), ("m", pa.list_(pa.int64()))]))


def chained_costs(t: pa.Table) -> pa.Table:
    """block, c, ends, start of one conversation's pieces in blocks: what follows each costs, and whether it is the first."""
    t = t.sort_by("block")
    ends, after = [], ENDING
    for m in reversed(t.column("m").to_pylist()):
        ends.append(after.tolist())
        after = before(np.array(m).reshape(4, 4), after)
    return pa.table({"block": t.column("block"), "c": t.column("c"), "ends": pa.array(ends[::-1], pa.list_(pa.int64())), "start": [i == 0 for i in range(len(t))]})


EDITED = pa.schema([("block", pa.int64()), ("c", pa.string()), ("known", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("entry", pa.int32()), ("leads", pa.int32()), ("edits", pa.binary())])


def edited(t: pa.Table, given: pa.Table) -> pa.Table:
    """The edits of a block's pieces: where they start in the order, entry and end state, a byte per row (fault * 16 + edit).

    A piece that doesn't start its conversation gets a row for each state that it may be entered in.
    """
    if not len(t):
        return EDITED.empty_table()
    t, starts, lengths, names, x, f = pieces_in(t)
    known = {r["c"]: r for r in given.to_pylist()}
    ends = np.array([known[c]["ends"] if c in known else ENDING for c in names])
    edits, leads = solved(x, f, starts, lengths, ends)
    edits = edits + (f * 16).astype(np.uint8)[:, None]
    which = [(k, s) for k, c in enumerate(names) for s in ([0] if c not in known or known[c]["start"] else range(4))]
    rows = t.take(pa.array([starts[k] for k, _ in which]))
    more = [pa.array([s for _, s in which], pa.int32()), pa.array([leads[k, s] for k, s in which], pa.int32()), pa.array([edits[starts[k] : starts[k] + lengths[k], s].tobytes() for k, s in which], pa.binary())]
    return pa.Table.from_arrays([*(rows.column(n) for n in ("block", "c", "known", "turn", "role", "digest")), *more], schema=EDITED)


def chained_states(t: pa.Table) -> pa.Table:
    """block, c, entry: the state in which each of one conversation's pieces is entered."""
    leads = {(r["block"], r["entry"]): r["leads"] for r in t.to_pylist()}
    state, out = 0, []
    for b in sorted({b for b, _ in leads}):
        out.append((b, t.column("c")[0].as_py(), state))
        state = leads[b, state]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int32()))], names=["block", "c", "entry"])


class Conversation:
    """What streams through of one conversation."""

    def __init__(self, c: str):
        self.c, self.state, self.key, self.edits, self.at = c, 0, None, b"", 0
        self.hash, self.lines, self.audit, self.last = hashlib.sha256(), 0, bytearray(), None
        self.turns: list[int] = []
        self.n = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.line(ROLES[self.state], "")
        self.audit += b"I"
        self.n["cost"] += 2
        self.state = int(NEXT[self.state])

    def row(self, known: bool, turn: int, role: str, digest: bytes, text: str, copies: int) -> None:
        key, n = (known, turn, role, digest), self.n
        initial = "sua".find(role[0]) if role else -1
        if key != self.key:
            if known and (not self.turns or turn != self.turns[1]):
                self.turns = [self.turns[0], turn, self.turns[2] + 1] if self.turns else [turn, turn, 1]
            self.key, code = key, self.edits[self.at]
            self.at += 1
            fault, edit = code >> 4, code & 3
            n["illegal"] += self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1))
            for _ in range(code >> 2 & 3):
                self.insert()
            self.audit += b"KRD"[edit : edit + 1]
            n["cost"] += (3 if edit == DELETE else (2 if edit == REROLE else 0) + (fault == TRUNCATED))
            for name, bit in (("blank", BLANK), ("duplicate", REPEAT), ("truncated", TRUNCATED)):
                n[name] += fault == bit
            if edit == REROLE:
                self.line(ROLES[self.state], text)
                self.state = int(NEXT[self.state])
            elif edit == KEEP:
                self.line(role, text)
                self.state = int(KEPT[initial, self.state])
            self.last, copies = initial, copies - 1
        n["illegal"] += copies
        n["cost"] += 3 * copies
        n["blank" if self.edits[self.at - 1] >> 4 == BLANK else "duplicate"] += copies
        self.audit += b"D" * copies

    def result(self) -> dict:
        while self.state in (1, 2):
            self.insert()
        if self.turns:
            self.n["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return {"c": self.c, **self.n, "audit": self.audit.decode(), "repaired_sha256": self.hash.hexdigest()}


RESULT = pa.schema([("c", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose pieces and rows come in order (c, known, turn, role, digest, text, copies, edits)."""
    now, done = None, []
    for b in batches:
        for c, known, turn, role, digest, text, copies, edits in zip(*(b.column(i).to_pylist() for i in range(8))):
            if now is None or c != now.c:
                done += [now.result()] if now else []
                now = Conversation(c)
            if edits is not None:
                now.edits, now.at = edits, 0
            elif copies:
                now.row(known, turn, role, digest, text, copies)
        yield pa.RecordBatch.from_pylist(done, RESULT)
        done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.result()], RESULT)


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, damaged as the module says."""
    spark = conversations.sparkSession
    prepare(spark)
    under = shared_dir(spark, "repair")
    order = ["c", "known", "turn", "role", "digest"]
    rows = damaged(conversations).withColumn("digest", F.unhex(F.sha2("text", 256)))
    plain = kept(thin(rows), "thin", under)
    placed = with_repeats(plain).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = kept(placed.withColumn("block", F.floor(F.col("pos") / block)), "ordered", under)
    small = placed.select("block", "pos", "c", "initial", "fault")
    ends = small.groupBy("block").applyInArrow(edge_matrices, "block long, c string, m array<long>").groupBy("c").applyInArrow(chained_costs, "block long, c string, ends array<long>, start boolean")
    ends = kept(ends, "ends", under)
    pieces = placed.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(edited, "block long, c string, known boolean, turn long, role string, digest binary, entry int, leads int, edits binary")
    pieces = kept(pieces, "pieces", under)
    on = ["block", "c"]
    entered = pieces.join(ends.select(*on), on, "left_semi").select(*on, "entry", "leads").groupBy("c").applyInArrow(chained_states, "block long, c string, entry int")
    pieces = pieces.join(ends.select(*on), on, "left_anti").unionByName(pieces.join(entered, [*on, "entry"], "left_semi"))
    none = F.lit(None)
    both = rows.select(*order, "text", "copies", none.cast("binary").alias("edits")).unionByName(pieces.select(*order, none.cast("string").alias("text"), F.lit(0).alias("copies"), "edits"))
    both = both.repartition("c").sortWithinPartitions(*order, F.col("edits").isNull())
    out = kept(both.mapInArrow(streamed, SCHEMA), "repaired")
    dropped(spark, under)
    return out.select(F.when(F.col("c") != "", F.col("c")).cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *out.columns[1:])
