"""What the two repeat removers share: anchors of windows, the texts around them, and the bookkeeping of spans.

A window is `length` symbols (bytes or words) in a row. Every window holds a minimizer, the k symbols with the least hash
of all k in a row inside it, and equal windows hold equal minimizers at equal places. So all windows that two documents
share meet where the anchors are grouped by their hash, with the context of an anchor (all windows that hold it).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import U64, Ranges, binaries, minimizers, mixed, narrow, runs, widen
from gaugeframe.llm.storage import parts_of, stored

#: Bytes of an anchor's hash while anchors are compared; with the part they name it to over 50 bits. Contexts keep all 64.
WIDTH = 5
LAST = (1 << 63) - 1
#: Numbers that documents are hashed to before texts are shuffled.
SLOTS = 1 << 20


@dataclass(frozen=True)
class Kind:
    """How a text is read: `symbols` gives 64-bit symbols of its bytes, `width` their bytes in a context."""

    symbols: Callable[[np.ndarray], np.ndarray]
    codes: Callable[[np.ndarray], np.ndarray]
    length: int
    k: int


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Hash of each anchor, hash of its context, the context's start and end, and the anchor's place.

    The hash of a context covers its symbols and the anchor's place in it, so it names the anchor too.
    """
    n, reach = len(symbols), kind.length - kind.k
    if n < kind.length:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none.astype(U64), none, none, none
    ranges = Ranges(symbols)
    values = ranges.every(kind.k)
    at = minimizers(values, reach + 1)
    low, high = np.maximum(at - reach, 0), np.minimum(at + kind.length, n)
    return values[at], mixed(ranges.of(low, high) + (at - low).astype(U64)), low, high, at


def _part(anchor: np.ndarray, parts: int) -> np.ndarray:
    return ((anchor & U64(0xFFFF)) % U64(parts)).astype(np.int64)


def _concat(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


ANCHORS = "part int, ids binary, nodes binary, counts binary, anchors binary, contexts binary"


def _anchor_rows(kind: Kind, parts: int):
    """Packed rows of a batch: for a part, the anchors of each text. Equal texts of a batch count once, with the least id."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((ids, nodes))
            once = order[runs(nodes[order])]
            found, owners = [], []
            for i, text in enumerate(batch.column(2).take(pa.array(once)).to_pylist()):
                a, c, *_ = anchors(kind.symbols(_bytes(text)), kind)
                if len(a):
                    a, c = np.unique(np.stack([a, c]), axis=1) if len(a) != len(np.unique(a)) else (a, c)
                    found.append((a, c)), owners.append(np.full(len(a), i))
            if not found:
                continue
            a, c, owner = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.concatenate(owners)
            part = _part(a, parts)
            order = np.argsort(part, kind="stable")
            part, a, c, owner = part[order], a[order] >> U64(24), c[order], owner[order]
            cuts, out = np.searchsorted(part, np.arange(parts + 1)), []
            for p in range(parts):
                x, y = cuts[p], cuts[p + 1]
                if x < y:
                    own = owner[x:y]
                    first = runs(own)
                    held = once[own[first]]
                    counts = np.diff(np.append(first, y - x)).astype(np.int32)
                    out.append((p, ids[held].tobytes(), nodes[held].tobytes(), counts.tobytes(), narrow(a[x:y], WIDTH), c[x:y].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i in range(6)], names=["part", "ids", "nodes", "counts", "anchors", "contexts"]
            )

    return f


JUDGED = "part int, ids binary, nodes binary, covered_counts binary, wanted_counts binary, covered binary, wanted binary"


def _judge(parts: int):
    """What the anchors of a part say about each document, packed in one row for each part that documents are dealt to.

    An anchor of one document says nothing. Of equal contexts only that of the least document is kept; the others are
    covered, as a context is a window at least and stands in a lesser document. Where an anchor still has different
    contexts, they are wanted for the index.
    """

    def f(table: pa.Table) -> pa.Table:
        ids, nodes, counts = (_concat(table.column(c), t) for c, t in (("ids", "<i8"), ("nodes", "<i8"), ("counts", "<i4")))
        a, c = widen(b"".join(table.column("anchors").to_pylist()), WIDTH), _concat(table.column("contexts"), "<u8")
        owner = np.repeat(np.arange(len(ids)), counts)
        who = ids[owner]
        order = np.lexsort((who, c, a))
        a, c, owner, who = a[order], c[order], owner[order], who[order]
        by_anchor = runs(a)
        spread = lambda v, first: np.repeat(v, np.diff(np.append(first, len(a))))
        several = spread(np.minimum.reduceat(who, by_anchor) != np.maximum.reduceat(who, by_anchor), by_anchor)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        by_context = np.flatnonzero(new)
        covered = several & (who > spread(who[by_context], by_context))
        contexts = spread(np.add.reduceat(new.astype(np.int64), by_anchor), by_anchor)
        wanted = several & ~covered & (contexts > 1)
        keep = np.flatnonzero(covered | wanted)
        to = (mixed(ids.astype(U64) ^ mixed(nodes.astype(U64))) % U64(parts)).astype(np.int64)
        keep = keep[np.lexsort((owner[keep], to[owner[keep]]))]
        owner, names, covered = owner[keep], c[keep].astype("<u8"), covered[keep]
        docs = owner[runs(owner)]  # those of one part stand together, so each is one run
        out = []
        cuts = np.append(runs(to[docs]), len(docs))
        for first, end in zip(cuts, cuts[1:]):
            held = docs[first:end]
            own = slice(np.searchsorted(to[owner], to[held[0]]), np.searchsorted(to[owner], to[held[0]], "right"))
            sizes = lambda which: np.diff(np.append(0, np.cumsum(which)[np.append(runs(owner[own])[1:], len(which)) - 1])).astype("<i4").tobytes()
            which = covered[own]
            out.append((int(to[held[0]]), ids[held].tobytes(), nodes[held].tobytes(), sizes(which), sizes(~which), names[own][which].tobytes(), names[own][~which].tobytes()))
        return pa.table([pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i in range(7)], names=[c.split()[0] for c in JUDGED.split(", ")])

    return f


SAID = "id long, node long, covered binary, wanted binary"


def _gathered(table: pa.Table) -> pa.Table:
    """A row for each document of a part with all that was said about it."""
    ids, nodes = (_concat(table.column(c), "<i8") for c in ("ids", "nodes"))
    order = np.lexsort((nodes, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (nodes[order][1:] != nodes[order][:-1])
    group = np.zeros(len(ids), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]

    def cells(kind: str) -> pa.Array:
        of = np.repeat(group, _concat(table.column(f"{kind}_counts"), "<i4"))
        names = _concat(table.column(kind), "<u8")[np.argsort(of, kind="stable")]
        return binaries(names.tobytes(), 8 * np.cumsum(np.bincount(of, minlength=len(first))))

    return pa.table([pa.array(ids[first]), pa.array(nodes[first]), cells("covered"), cells("wanted")], names=["id", "node", "covered", "wanted"])


WORKED = "id long, node long, n_removed long, n_spans long, kept string, text binary, starts binary, ends binary, names binary, lows binary, part int, ids binary, nodes binary, anchors binary, sizes binary, lefts binary, codes binary"
COLUMNS = [c.split() for c in WORKED.split(", ")]
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _without(kind: Kind, data: np.ndarray, edge: np.ndarray, keep) -> tuple[int, int, str]:
    """Symbols and runs that go, and the hash of what stays; `edge` has +1 where a range starts and -1 where it ends."""
    gone = np.cumsum(edge[:-1]) > 0
    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return int(gone.sum()), spans, hashlib.sha256(keep(data, ~gone)).hexdigest()


def _edges(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return edge


def _context_rows(kind: Kind, parts: int, keep):
    """For each document that shares an anchor: its result if no context is wanted; else a row with its text and
    covered ranges, and packed rows with its wanted contexts."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            packed: dict[int, list] = {}
            for id_, node, text, covered, wanted in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                data = _bytes(text)
                codes = kind.codes(data)
                a, names, low, high, at = anchors(kind.symbols(data), kind)
                hit = np.isin(names, np.frombuffer(covered, "<u8"))
                want = np.isin(names, np.frombuffer(wanted, "<u8"))
                if not want.any():
                    removed, spans, kept = _without(kind, data, _edges(len(codes), low[hit], high[hit]), keep)
                    rows.append({"id": id_, "node": node, "n_removed": removed, "n_spans": spans, "kept": kept})
                    continue
                rows.append({"id": id_, "node": node, "text": zlib.compress(data.tobytes(), 1), "starts": low[hit].astype("<i4").tobytes(), "ends": high[hit].astype("<i4").tobytes(),
                             "names": names[want].astype("<u8").tobytes(), "lows": low[want].astype("<i4").tobytes()})
                _, once = np.unique(names[want], return_index=True)
                for i, p in zip(np.flatnonzero(want)[once], _part(a[want][once], parts), strict=True):
                    packed.setdefault(int(p), []).append((id_, node, int(names[i]), codes[low[i] : high[i]], at[i] - low[i], int(a[i] >> U64(24))))
            for p, held in packed.items():
                rows.append({"part": p, "ids": np.array([h[0] for h in held], "<i8").tobytes(), "nodes": np.array([h[1] for h in held], "<i8").tobytes(),
                             "names": np.array([h[2] for h in held], "<u8").tobytes(), "anchors": np.array([h[5] for h in held], "<u8").tobytes(), "sizes": np.array([len(h[3]) for h in held], "<i4").tobytes(),
                             "lefts": np.array([h[4] for h in held], "<i4").tobytes(), "codes": zlib.compress(np.concatenate([h[3] for h in held]).tobytes(), 1)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], KINDS[t]) for c, t in COLUMNS], names=[c for c, _ in COLUMNS])

    return f


SPANS = "id long, node long, spans binary"
SPAN = np.dtype([("name", "<u8"), ("start", "<i4"), ("end", "<i4")])


def _reach(codes: np.ndarray, begin: np.ndarray, room: np.ndarray, step: int, most: int, anchor: np.ndarray) -> np.ndarray:
    """How many symbols from `begin` on (backwards for step -1) each context shares with any other one of its anchor, at most."""
    inside = np.arange(most)[None, :] < room[:, None]
    at = np.where(inside, begin[:, None] + step * np.arange(most)[None, :], 0)
    wide = np.uint16 if codes.itemsize == 1 else np.uint64
    rows = np.where(inside, codes[at].astype(wide) + wide(1), wide(0))
    order = np.lexsort((*rows.T[::-1], anchor))
    rows = rows[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    shared = np.where(same.all(axis=1), most, (~same).argmax(axis=1)) * (anchor[order][1:] == anchor[order][:-1])
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(np.append(shared, 0), np.append(0, shared))
    return out


def _indexed(index, dtype: str, most: int, kind: Kind):
    """Search the contexts of a part: `index` gets some at a time, all of an anchor together, and tells what to remove of each.

    A context is first cut to what it shares with any other of its anchor, before and behind; shorter than a window, it is
    done. Strings that are equal then go in once, for the least document; in the others they are covered. Where an
    anchor still has different strings, the index tells what they share.
    """

    def f(table: pa.Table) -> pa.Table:
        ids, nodes, names, anchor = (_concat(table.column(c), t) for c, t in (("ids", "<i8"), ("nodes", "<i8"), ("names", "<u8"), ("anchors", "<u8")))
        sizes, lefts = (_concat(table.column(c), "<i4").astype(np.int64) for c in ("sizes", "lefts"))
        codes = np.frombuffer(b"".join(map(zlib.decompress, table.column("codes").to_pylist())), dtype)
        first, more = np.cumsum(sizes) - sizes, kind.length - kind.k
        before = _reach(codes, first + lefts - 1, lefts, -1, more, anchor)
        behind = _reach(codes, first + lefts + kind.k, sizes - lefts - kind.k, 1, more, anchor)
        low, high = lefts - before, lefts + kind.k + behind
        order = np.lexsort((ids, anchor))
        order = order[(high - low)[order] >= kind.length]
        string = lambda i: codes[first[i] + low[i] : first[i] + high[i]]
        which, start, end = [], [], []
        held: list[int] = []
        volume = 0
        for group in np.split(order, runs(anchor[order])[1:]) if len(order) else []:
            owners: dict[bytes, int] = {}
            twins = []  # of an owner, with the same id
            for i in group.tolist():  # by ascending ids
                other = owners.setdefault(string(i).tobytes(), i)
                if ids[other] < ids[i]:
                    which.append(i), start.append(low[i]), end.append(high[i])
                elif other != i:
                    twins.append(i)
            if len(owners) > 1:
                held += [*owners.values(), *twins]
                volume += int((high - low)[list(owners.values())].sum())
            if held and (volume >= most or group[-1] == order[-1]):
                held.sort(key=lambda x: ids[x])
                w, s, e = index([string(x) for x in held], ids[held])
                w = np.array(held)[w]
                which += w.tolist()
                start += (s + low[w]).tolist()
                end += (e + low[w]).tolist()
                held, volume = [], 0
        which, start, end = (np.array(x, np.int64) for x in (which, start, end))
        by = np.lexsort((ids[which], nodes[which]))
        which, start, end = which[by], start[by], end[by]
        spans = np.zeros(len(which), SPAN)
        spans["name"], spans["start"], spans["end"] = names[which], start, end
        new = np.ones(len(which), bool)
        new[1:] = (ids[which][1:] != ids[which][:-1]) | (nodes[which][1:] != nodes[which][:-1])
        head = np.flatnonzero(new)
        ends = np.append(head[1:], len(which)) if len(head) else head
        return pa.table([pa.array(ids[which[head]]), pa.array(nodes[which[head]]), binaries(spans.tobytes(), ends * SPAN.itemsize)], names=["id", "node", "spans"])

    return f


DONE = "id long, node long, n_removed long, n_spans long, kept string"


def _removed(kind: Kind, keep: Callable[[np.ndarray, np.ndarray], bytes]):
    """Join all ranges of a document and take them out."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, node, text, starts, ends, names, lows, spans in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                data = np.frombuffer(zlib.decompress(text), np.uint8)
                edge = _edges(len(kind.codes(data)), np.frombuffer(starts, "<i4"), np.frombuffer(ends, "<i4"))
                found = np.frombuffer(b"".join(spans or []), SPAN)
                names, lows = np.frombuffer(names, "<u8"), np.frombuffer(lows, "<i4")
                found = found[np.argsort(found["name"], kind="stable")]
                left, right = np.searchsorted(found["name"], names), np.searchsorted(found["name"], names, "right")
                which = np.concatenate([np.arange(x, y) for x, y in zip(left, right, strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
                base = np.repeat(lows, right - left)
                np.add.at(edge, base + found["start"][which], 1)
                np.add.at(edge, base + found["end"][which], -1)
                out.append((id_, node, *_without(kind, data, edge, keep)))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in DONE.split(", ")])

    return f


def remove_repeats(documents: DataFrame, kind: Kind, index, dtype: str, most: int, keep, size: Column, whole: Column) -> DataFrame:
    """(doc_id, size, n_removed, n_spans, kept_sha256) of every row of (doc_id, text): what windows that start in a document with a lesser doc_id cover is removed.

    `size` is the number of symbols of a text and `whole` what stays of one without repeats. Copies of a lesser
    document's whole text need no search. Everything else goes through anchors, contexts and `index`; texts are
    shuffled once, and only for documents that share an anchor.
    """
    parts = parts_of(documents.sparkSession)
    keyed = documents.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("node", F.xxhash64("text"))
    packed = keyed.select("id", "node", "text").mapInArrow(_anchor_rows(kind, parts), ANCHORS)
    judged = packed.groupBy("part").applyInArrow(_judge(parts), JUDGED)
    said = stored(judged.groupBy("part").applyInArrow(_gathered, SAID), "judged")
    # a broadcast of SLOTS numbers at most keeps most texts that share nothing out of the shuffle; the join is what decides
    slot = F.pmod(F.xxhash64("id", "node"), F.lit(SLOTS)).alias("slot")
    texts = keyed.select("id", "node", "text", slot).join(F.broadcast(said.select(slot).distinct()), "slot", "left_semi").drop("slot")
    touched = texts.join(said, ["id", "node"])
    worked = stored(touched.mapInArrow(_context_rows(kind, parts, keep), WORKED), "contexts")
    contexts = worked.filter(F.col("part").isNotNull()).select("part", "ids", "nodes", "names", "anchors", "sizes", "lefts", "codes")
    spans = contexts.groupBy("part").applyInArrow(_indexed(index, dtype, most, kind), SPANS)
    spans = spans.groupBy("id", "node").agg(F.collect_list("spans").alias("spans"))
    begun = worked.filter(F.col("text").isNotNull()).select("id", "node", "text", "starts", "ends", "names", "lows")
    done = begun.join(spans, ["id", "node"], "left").mapInArrow(_removed(kind, keep), DONE)
    done = done.union(worked.filter(F.col("kept").isNotNull()).select("id", "node", "n_removed", "n_spans", "kept")).dropDuplicates(["id", "node"])
    light = keyed.select("doc_id", "id", "node", F.md5("text").alias("digest"), size.alias("size"), F.sha2(whole, 256).alias("whole"))
    first = light.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & (F.col("size") >= kind.length)
    joined = light.join(first, ["id", "digest"], "left").join(done, ["id", "node"], "left")
    value = lambda of_copy, found, other: F.when(copy, of_copy).otherwise(F.coalesce(found, other))
    return joined.select(
        "doc_id", "size", value(F.col("size"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        value(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        value(F.sha2(F.lit("").cast("binary"), 256), F.col("kept"), F.col("whole")).alias("kept_sha256"),
    )
