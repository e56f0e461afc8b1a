"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of order.

Roles must read `(s?(ua)+)?` (system, then user and assistant by turns). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2,
Insert an empty turn 5; keeping a cut-off turn costs 5 more, and blank and repeated turns must go. A dynamic program over four
states (nothing, system, user, assistant said last) runs backward over one byte a turn. Its vectors stay at every root of n-th turn
only; walking forward, a block's vectors are computed anew and the ASCII-least edit that keeps the least cost is taken.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.storage import stored

#: Turns and characters of a chunk; a conversation of more is worked on chunk by chunk.
ROWS = 1024
CHARACTERS = 1 << 20

SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: A turn's byte: its role, plus this where it is cut off, plus that where it must go.
CUT, GOES = 4, 8
START, S, U, A = range(4)
FAR = 1 << 60
#: The state after an inserted or reroled turn, and its role.
NEXT = (U, U, A, U)
NAMES = ("user", "user", "assistant", "user")
WORD = re.compile("[^\x20\x09-\x0d]")
SPACES = " \t\n\x0b\x0c\r"


# ---- one conversation ----


def role_class(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def text_fault(text: str) -> str | None:
    """blank, truncated or None."""
    bare = text.rstrip(SPACES)
    if not bare:
        return "blank"
    return None if bare[-1] in ".!?" else "truncated"


def _relaxed(b0: int, bs: int, bu: int, ba: int) -> tuple[int, int, int, int]:
    """Costs where a turn may also be inserted first."""
    bu, ba = min(bu, ba + 5), min(ba, bu + 5)
    return min(b0, bu + 5), min(bs, bu + 5), bu, ba


END = _relaxed(0, FAR, FAR, 0)
_STEPS: dict[tuple[int, tuple], tuple[int, tuple]] = {}


def before(code: int, after: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Costs to the end from each state before a turn, from those after it. Only their differences matter, so few cases are ever new."""
    least = min(after)
    key = code, tuple(v - least for v in after)
    if key not in _STEPS:
        a0, as_, au, aa = key[1]
        b = [a0 + 2, as_ + 2, au + 2, aa + 2]
        if code < GOES:
            more, role = (5 if code & CUT else 0), code & 3
            b[START] = min(b[START], au + more + (role != USER), as_ + more if role == SYSTEM else FAR)
            b[S] = min(b[S], au + more + (role != USER))
            b[U] = min(b[U], aa + more + (role != ASSISTANT))
            b[A] = min(b[A], au + more + (role != USER))
        _STEPS[key] = _relaxed(*b)
    return tuple(v + least for v in _STEPS[key])


def edits(codes: bytes) -> tuple[int, str]:
    """(least cost, ASCII-least initials of the cheapest edits) of a conversation's turns."""
    n = len(codes)
    block = max(1, math.isqrt(n))
    held = {n: END}
    vector = END
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % block == 0:
            held[i] = vector
    cost, state, out = vector[START], START, []
    for begin in range(0, n, block):
        end = min(begin + block, n)
        vectors = [held[end]]
        for i in range(end - 1, begin - 1, -1):
            vectors.append(before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(begin, end):
            here, after, code = vectors[i - begin], vectors[i - begin + 1], codes[i]
            more, role = (5 if code & CUT else 0), code & 3
            while True:
                if here[state] == after[state] + 2:
                    out.append("D")
                    break
                if here[state] == here[NEXT[state]] + 5:
                    out.append("I")
                    state = NEXT[state]
                    continue
                kept = S if role == SYSTEM and state == START else NEXT[state] if role == NEXT[state] - 1 else None
                if kept is not None and here[state] == after[kept] + more:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = NEXT[state]
                break
    while END[state]:
        out.append("I")
        state = NEXT[state]
    return cost, "".join(out)


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """(roles, texts, state after) of the repaired turns of a conversation, or of a piece that begins in `state`."""
    new_roles, new_texts, i = [], [], 0
    for letter in audit:
        if letter == "I":
            new_roles.append(NAMES[state]), new_texts.append("")
            state = NEXT[state]
            continue
        if letter == "K":
            new_roles.append(roles[i]), new_texts.append(texts[i])
            state = S if role_class(roles[i]) == SYSTEM else NEXT[state]
        elif letter == "R":
            new_roles.append(NAMES[state]), new_texts.append(texts[i])
            state = NEXT[state]
        i += 1
    return new_roles, new_texts, state


def lines(roles: list[str], texts: list[str]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


@dataclass
class Turns:
    """A piece of a conversation and what is counted in it."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    characters: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.roles.append(role), self.texts.append(text), self.turns.append(turn)
        self.characters += len(text)

    def full(self) -> bool:
        return len(self.roles) >= ROWS or self.characters >= CHARACTERS

    def codes(self) -> bytes:
        """Roles and faults of single turns; repeated turns are not told."""
        faults = {None: 0, "truncated": CUT, "blank": GOES}
        return bytes(role_class(r) + faults[text_fault(t)] for r, t in zip(self.roles, self.texts, strict=True))

    def digests(self) -> list[bytes]:
        return [hashlib.md5(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() for r, t in zip(self.roles, self.texts, strict=True)]


def counted(pieces: Iterable[tuple[bytes, list[bool], list[int | None]]]) -> tuple[list[int], bytes]:
    """([gaps, blank, duplicate, truncated, illegal], codes with repeated turns) of (codes, first of its kind, turns) in order."""
    blank = duplicate = truncated = illegal = distinct = 0
    low = high = last = None
    out = bytearray()
    for codes, first, turns in pieces:
        for code, new, turn in zip(codes, first, turns, strict=True):
            role = code & 3
            if last is not None and (last, role) not in LEGAL:
                illegal += 1
            last = role
            if code >= GOES:
                blank += 1
            elif not new:
                duplicate += 1
                code = role | GOES
            elif code & CUT:
                truncated += 1
            out.append(code)
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
    gaps = 0 if low is None else high - low + 1 - distinct
    return [gaps, blank, duplicate, truncated, illegal], bytes(out)


# ---- many conversations ----

STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], at_a_time: int = 512) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(sum(map(len, v)) for v in row if isinstance(v, list) and v and isinstance(v[0], str))
        if len(held) >= at_a_time or size >= CHARACTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


TEXTS = pa.list_(pa.string())
RESULT = [(s, "long", pa.int64()) for s in STATS] + [("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())]
TURNS = [("roles", "array<string>", TEXTS), ("texts", "array<string>", TEXTS)]
PLACE = [("part", "int", pa.int32()), ("chunk", "int", pa.int32())]
CHUNK = [("turns", "array<long>", pa.list_(pa.int64())), ("codes", "binary", pa.binary()), ("digests", "array<binary>", pa.list_(pa.binary()))]


def _ddl(key: str, *columns: list[tuple]) -> str:
    return ", ".join([f"conv_id {key}", *[f"{n} {t}" for c in columns for n, t, _ in c]])


def _named(key: pa.DataType, *columns: list[tuple]) -> tuple[list[str], list[pa.DataType]]:
    return ["conv_id", *[n for c in columns for n, *_ in c]], [key, *[t for c in columns for *_, t in c]]


def _finished(turns: Turns, keep_turns: bool) -> tuple:
    seen: set[bytes] = set()
    first = [not (d in seen or seen.add(d)) for d in turns.digests()]
    stats, codes = counted([(turns.codes(), first, turns.turns)])
    cost, audit = edits(codes)
    roles, texts, _ = apply(audit, START, turns.roles, turns.texts)
    digest = hashlib.sha256(lines(roles, texts).encode("utf-8", "surrogatepass")).hexdigest()
    return (*stats, cost, audit, digest, *((roles, texts) if keep_turns else (None, None)))


def _first_pass(keep_turns: bool):
    """Conversations that lie inside a task's rows and in one chunk are done; of others come chunks."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        names, types = _named(head.schema.field(0).type, RESULT, TURNS, PLACE, CHUNK)
        part, n_chunks = TaskContext.get().partitionId(), 0

        def chunk(conv, turns: Turns) -> tuple:
            nonlocal n_chunks
            n_chunks += 1
            return (conv, *[None] * len(RESULT), turns.roles, turns.texts, part, n_chunks, turns.turns, turns.codes(), turns.digests())

        def rows() -> Iterator[tuple]:
            conv, turns, open_, begun = None, None, True, False
            for c, turn, role, text in _rows(b for bs in ([head], batches) for b in bs):
                if not begun or c != conv:
                    if begun and open_:
                        yield chunk(conv, turns)
                        open_ = False
                    elif begun:
                        yield (conv, *_finished(turns, keep_turns), None, None, None, None, None)
                    conv, turns = c, Turns()
                    begun, open_ = True, not begun
                if text is None:
                    continue
                turns.add(turn, role, text)
                if turns.full():
                    yield chunk(conv, turns)
                    turns, open_ = Turns(), True
            if begun:
                yield chunk(conv, turns)

        yield from _batches(rows(), names, types)

    return f


def _by_conversation(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        if held and row[0] != held[0][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


PLAN = [*PLACE, ("state", "int", pa.int32()), *RESULT[:-1]]


def _plans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk its edits and the state it begins in; the first one of a conversation also has the counts."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    names, types = _named(head.schema.field(0).type, PLAN)

    def rows() -> Iterator[tuple]:
        for chunks in _by_conversation(_rows(b for bs in ([head], batches) for b in bs)):
            pieces = []
            for *_, codes, turns, firsts in chunks:
                new = np.zeros(len(codes), bool)
                new[firsts or []] = True
                pieces.append((codes, new.tolist(), turns))
            stats, codes = counted(pieces)
            cost, audit = edits(codes)
            state, at, row = START, 0, 0
            for k, (conv, part, n, own, *_) in enumerate(chunks):
                begin, begin_state, left = at, state, len(own)
                while at < len(audit) and (left or audit[at] == "I" and k == len(chunks) - 1):
                    letter = audit[at]
                    if letter == "K" and state == START and codes[row] & 3 == SYSTEM:
                        state = S
                    elif letter != "D":
                        state = NEXT[state]
                    left, row, at = left - (letter != "I"), row + (letter != "I"), at + 1
                yield (conv, part, n, begin_state, *([None] * len(STATS) if k else [*stats, cost]), audit[begin:at])

    yield from _batches(rows(), names, types)


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of chunks from (conv_id, part, chunk, state, audit, roles, texts)."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    names, types = _named(head.schema.field(0).type, PLACE, TURNS)
    rows = _rows(b for bs in ([head], batches) for b in bs)
    yield from _batches(((conv, part, chunk, *apply(audit, state, roles, texts)[:2]) for conv, part, chunk, state, audit, roles, texts in rows), names, types)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the lines of each conversation; its chunks come in order and are let go one by one."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    names, types = _named(head.schema.field(0).type, [RESULT[-1]])

    def rows() -> Iterator[tuple]:
        conv, digest, any_line, begun = None, hashlib.sha256(), False, False
        for c, roles, texts in _rows(b for bs in ([head], batches) for b in bs):
            if begun and c != conv:
                yield conv, digest.hexdigest()
                digest, any_line = hashlib.sha256(), False
            conv, begun = c, True
            if roles:
                digest.update((("\n" if any_line else "") + lines(roles, texts)).encode("utf-8", "surrogatepass"))
                any_line = True
        if begun:
            yield conv, digest.hexdigest()

    yield from _batches(rows(), names, types)


@dataclass(frozen=True)
class Repaired:
    """`summary`: a row for each conversation. `turns`: the repaired turns, if asked for: (conv_id, part, chunk, place, role, text)."""

    summary: DataFrame
    turns: DataFrame | None


def repair(rows: DataFrame, dropped: Column | None = None, keep_turns: bool = False) -> Repaired:
    """Repair every conversation of (conv_id, turn, role, text).

    Nulls of role and text are one space; a null conv_id is a conversation of its own. Turns go by `turn`, nulls first, then by role
    and text hash; repeated rows stay and count as repeated turns. Rows for which `dropped` holds are left out, but
    their conversation is reported: zeros, an empty audit and the hash of nothing if no other row is left.

    Rows are sorted over all tasks by conversation and turn, so a conversation of any size is spread. One that lies within a task and a
    chunk is done there. Others are cut in chunks: repeated turns come from a grouping of digests, edits from the chunks' bytes
    (one a turn, as many as letters in the result), and hashes from a stream of chunks.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)
    text = F.when(~out, F.coalesce(F.col("text"), F.lit(" ")))
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "_hash", "_row"]
    keyed = slim.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    key = rows.schema["conv_id"].dataType.simpleString()
    first = stored(placed.mapInArrow(_first_pass(keep_turns), _ddl(key, RESULT, TURNS, PLACE, CHUNK)), "conversations")
    result = ["conv_id", *[n for n, *_ in RESULT]]
    chunks = first.filter(F.col("part").isNotNull())
    # repeated turns: the first place of each digest, combined in the tasks before they are grouped
    places = chunks.select("conv_id", "part", "chunk", F.posexplode("digests").alias("place", "digest"))
    firsts = places.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "chunk", "place")).alias("at")).select("at.*")
    firsts = firsts.groupBy("part", "chunk").agg(F.collect_list("place").alias("firsts"))
    slim = chunks.select("conv_id", "part", "chunk", "codes", "turns").join(firsts, ["part", "chunk"], "left")
    ordered = lambda df: df.repartition(n_parts, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    plans = stored(ordered(slim).select("conv_id", "part", "chunk", "codes", "turns", "firsts").mapInArrow(_plans, _ddl(key, PLAN)), "plans")
    parts = chunks.select("conv_id", "part", "chunk", "roles", "texts").join(plans.select("part", "chunk", "state", "audit"), ["part", "chunk"])
    applied = parts.select("conv_id", "part", "chunk", "state", "audit", "roles", "texts").mapInArrow(_applied, _ddl(key, PLACE, TURNS))
    applied = stored(applied, "repaired")
    hashed = ordered(applied).select("conv_id", "roles", "texts").mapInArrow(_hashed, _ddl(key, [RESULT[-1]]))
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk", "audit"))), lambda x: x["audit"])).alias("audit")
    told = plans.groupBy("conv_id").agg(*[F.max(s).alias(s) for s in STATS], audit)
    same = told["conv_id"].eqNullSafe(hashed["conv_id"])
    long_ones = told.join(hashed, same).select(told["conv_id"], *STATS, "audit", "repaired_sha256")
    summary = first.filter(F.col("part").isNull()).select(*result).union(long_ones)
    if not keep_turns:
        return Repaired(summary, None)
    both = first.filter(F.col("part").isNull()).select("conv_id", "part", "chunk", "roles", "texts").union(applied.select("conv_id", "part", "chunk", "roles", "texts"))
    turns = both.select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t"))
    return Repaired(summary, turns.select("conv_id", "part", "chunk", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): a twentieth of the rows each dropped, emptied, stripped of `.!?`, repeated and made the user's, by a crc32 of conv_id and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), times.alias("_times"))
    return rows.withColumn("_time", F.explode("_times")).drop("_times", "_time")
