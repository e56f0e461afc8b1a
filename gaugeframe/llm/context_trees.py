"""Code lengths of texts by context-tree weighting over bytes, beside a unigram of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import LOWER_SYMBOLS, U64, Ranges, mixed, runs, word_bounds
from gaugeframe.llm.jaccard import chunked
from gaugeframe.llm.storage import parts_of, stored

#: Bytes of context. A text begins after so many zero bytes.
DEPTH = 5
#: Leaves that are sent to every worker as a table of 12 bytes each; more are asked for by a shuffle instead.
MOST_LEAVES = 6_000_000
END = np.array([0x5BF0363DB9A1C3E7], U64)
#: Coded after the last byte of a text. No UTF-8 text holds it, so no coded text is the beginning of another.
STOP = b"\xff"
LN10 = float(np.log(10.0))


def stopped(texts: list[bytes]) -> list[bytes]:
    return [t + STOP for t in texts]


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, its text and a key: the five bytes before it, the latest highest, and then the byte itself."""
    pad = bytes(DEPTH)
    data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(U64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + DEPTH * (owner + 1)
    key = data[at]
    for back in range(1, DEPTH + 1):
        key = key | (data[at - back] << U64(8 * (DEPTH + 1 - back)))
    return owner, key


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the last two bytes of context, so a part has whole subtrees."""
    return (mixed(keys >> U64(8 * (DEPTH - 1))) % U64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int, *arrays: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            which = order[cuts[p] : cuts[p + 1]]
            yield (p, *[a[which].tobytes() for a in arrays])


def _batch(rows: list[tuple], names: str, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names.split())


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(parts: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            texts = batch.column(0).to_pylist()
            for _, held in chunked(np.arange(len(texts)), texts):
                k, n = np.unique(keys_of(stopped(held))[1], return_counts=True)
                found.append(k), counts.append(n)
            k, n = _summed(np.concatenate(found), np.concatenate(counts))
            yield _batch(list(_by_part(_part(k, parts), parts, k, n)), "part keys counts", [pa.int32(), pa.binary(), pa.binary()])

    return f


def _join(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _add(table: pa.Table) -> pa.Table:
    k, n = _summed(_join(table, "keys", "<u8"), _join(table, "counts", "<i8"))
    return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["part", "keys", "counts"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y, below = x + 8.0, np.ones_like(x)
    for i in range(8):
        below = below * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(below)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a block with so many zeros and ones, in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


class Trees:
    """The weighted trees of one part, of depths 2 to 5: a node is a context with a prefix of the next byte's bits (1 to 255)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte = keys & U64(255)
        self.nodes: dict[int, tuple[np.ndarray, ...]] = {}
        below = None
        for d in range(DEPTH, 1, -1):
            context = keys >> U64(8 * (DEPTH + 1 - d))
            leaf, n = _summed((context << U64(8)) | byte, counts)
            context, b = leaf >> U64(8), leaf & U64(255)
            ids, zeros, ones = [], [], []
            for t in range(8):
                bit = (b >> U64(7 - t)) & U64(1)
                ids.append((context << U64(8)) | (U64(1 << t) | (b >> U64(8 - t))))
                ones.append(np.where(bit == 1, n, 0)), zeros.append(np.where(bit == 0, n, 0))
            ids = np.concatenate(ids)
            order = np.argsort(ids)
            first = runs(ids[order])
            zeros, ones = (np.add.reduceat(np.concatenate(x)[order], first) for x in (zeros, ones))
            ids = ids[order][first]
            kt = log_kt(zeros.astype(float), ones.astype(float))
            weighted = kt
            if below is not None:
                parent, value = below
                under = np.zeros(len(ids))
                np.add.at(under, np.searchsorted(ids, parent), value)
                weighted = np.logaddexp(kt, under) - np.log(2.0)
            self.nodes[d] = ids, zeros, ones, kt, weighted
            below = ((ids >> U64(16)) << U64(8)) | (ids & U64(255)), weighted

    def tops(self) -> tuple[np.ndarray, ...]:
        """(latest byte, prefix) with the zeros, ones and log weighted probability of the nodes of depth 2 below."""
        ids, zeros, ones, _, weighted = self.nodes[2]
        parent = ((ids >> U64(16)) << U64(8)) | (ids & U64(255))
        order = np.argsort(parent)
        first = runs(parent[order])
        return (parent[order][first], *[np.add.reduceat(x[order], first) for x in (zeros, ones, weighted)])

    def log_probability(self, keys: np.ndarray, top: tuple) -> np.ndarray:
        """Log probability of the byte of each key after its context: each bit mixes the estimates of all depths."""
        total = np.zeros(len(keys))
        byte = keys & U64(255)
        for t in range(8):
            prefix, bit = U64(1 << t) | (byte >> U64(8 - t)), ((byte >> U64(7 - t)) & U64(1)).astype(bool)
            q = np.full(len(keys), 0.5)
            for d in range(DEPTH, 1, -1):
                ids, zeros, ones, kt, weighted = self.nodes[d]
                wanted = ((keys >> U64(8 * (DEPTH + 1 - d))) << U64(8)) | prefix
                at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
                known = ids[at] == wanted
                own = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
                share = np.exp(kt[at] - weighted[at] - np.log(2.0)) if d < DEPTH else 1.0
                q = np.where(known, share * own + (1.0 - share) * q, 0.5)
            share1, one1, share0, one0 = top
            last = (keys >> U64(8 * DEPTH)).astype(np.int64) * 256 + prefix.astype(np.int64)
            for share, one, at in ((share1, one1, last), (share0, one0, prefix.astype(np.int64))):
                q = share[at] * np.where(bit, one[at], 1.0 - one[at]) + (1.0 - share[at]) * q
            total += np.log(q)
        return total


def _tops(table: pa.Table) -> pa.Table:
    node, zeros, ones, weighted = Trees(_join(table, "keys", "<u8"), _join(table, "counts", "<i8")).tops()
    return pa.table([pa.array(node.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(weighted)], names=["node", "zeros", "ones", "weighted"])


def top_levels(rows: list) -> tuple[np.ndarray, ...]:
    """Weight and chance of a one for the nodes of depths 1 and 0: 65,536 and 256 at most. A node never met says 1/2."""
    zeros, ones, under = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    for node, z, o, w in rows:
        zeros[node], ones[node], under[node] = z, o, w
    kt1 = log_kt(zeros, ones)
    weighted1 = np.logaddexp(kt1, under) - np.log(2.0)
    z0, o0, under0 = (x.reshape(256, 256).sum(axis=0) for x in (zeros, ones, weighted1))
    kt0 = log_kt(z0, o0)
    weighted0 = np.logaddexp(kt0, under0) - np.log(2.0)
    share = lambda kt, weighted: np.exp(kt - weighted - np.log(2.0))
    return share(kt1, weighted1), (ones + 0.5) / (zeros + ones + 1.0), share(kt0, weighted0), (o0 + 0.5) / (z0 + o0 + 1.0)


def _leaves(top: tuple):
    def f(table: pa.Table) -> pa.Table:
        keys, counts = _join(table, "keys", "<u8"), _join(table, "counts", "<i8")
        logs = Trees(keys, counts).log_probability(keys, top).astype("<f4")
        return pa.table([pa.array([keys.tobytes()], pa.binary()), pa.array([logs.tobytes()], pa.binary())], names=["keys", "logs"])

    return f


class Table:
    """Numbers by 64-bit keys, with open addressing: arrays only, so whole batches are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, U64), np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == U64(2**64 - 1)
            put, which = np.unique(slot[free], return_index=True)
            mine = left[free][which]
            self.keys[put], self.values[put] = keys[mine], values[mine]
            stay = self.keys[slot] != keys[left]
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known."""
        slot = self._slot(keys)
        there = self.keys[slot]
        value, known = self.values[slot], there == keys
        left = np.flatnonzero(~known & (there != U64(2**64 - 1)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            value[left[hit]], known[left[hit]] = self.values[slot[left[hit]]], True
            left = left[~hit & (there != U64(2**64 - 1))]
        return value, known


SCORED = "node long, log double, part int, nodes binary, keys binary, counts binary"


def _score(sent, parts: int):
    """Sums over the bytes whose leaf is at hand, and what has to be asked for, by part."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(sent.value[0], "<u8"), np.frombuffer(sent.value[1], "<f4"))
        types = [pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            nodes, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(once)).to_pylist()
            for some, held in chunked(nodes, texts):
                owner, key = keys_of(stopped(held))
                value, known = table.get(key)
                logs = np.bincount(owner, weights=np.where(known, value, 0.0), minlength=len(held))
                rows = [(int(n), float(x), None, None, None, None) for n, x in zip(some, logs, strict=True)]
                if not known.all():
                    asked = np.stack([owner[~known].astype(U64), key[~known]])
                    (who, what), n = np.unique(asked, axis=1, return_counts=True)
                    rows += [(None, None, *r) for r in _by_part(_part(what, parts), parts, some[who.astype(np.int64)], what, n)]
                yield _batch(rows, "node log part nodes keys counts", types)

    return f


def _answer(top: tuple):
    def f(trees: pa.Table, asked: pa.Table) -> pa.Table:
        nodes, keys, counts = (_join(asked, c, t) for c, t in (("nodes", "<i8"), ("keys", "<u8"), ("counts", "<i8")))
        each, back = np.unique(keys, return_inverse=True)
        known = (_join(trees, "keys", "<u8"), _join(trees, "counts", "<i8")) if trees.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
        # in the precision of the table of leaves, so a byte has one score whichever way it is looked up
        logs = (Trees(*known) if len(known[0]) else Nothing()).log_probability(each, top).astype("<f4").astype(float)[back] * counts
        held, at = np.unique(nodes, return_inverse=True)
        return pa.table([pa.array(held), pa.array(np.bincount(at, weights=logs, minlength=len(held)))], names=["node", "log"])

    return f


class Nothing(Trees):
    """A part in which no context was ever met."""

    def __init__(self) -> None:
        none = np.zeros(1)
        self.nodes = {d: (np.full(1, 2**64 - 1, U64), none, none, none, none) for d in range(2, DEPTH + 1)}


def tree_scores(texts: DataFrame, training: Column) -> DataFrame:
    """(node, log) for each distinct node of (node, text): the natural log of the probability of the text's bytes and its end.

    Counts of (five bytes, next byte) are summed over all rows where `training` holds. The latest two bytes of context
    deal them out, so each part weighs its trees from depth 5 up to 2; depths 1 and 0 are 65,792 nodes and come to the
    driver. A node's probability is half its own estimate and half the product of its children's, which gives each depth
    its weight in the mixture. A text's bytes are looked up in a table of the leaves met in training, if that
    has at most MOST_LEAVES entries; what is not there (all, if the table is larger) goes to the part that has its trees. Both
    give the same numbers. The end is coded as byte 255, which UTF-8 never holds, so all texts together have at most 1.
    """
    spark = texts.sparkSession
    parts = parts_of(spark)
    packed = texts.filter(training).select("text").mapInArrow(_count(parts), "part int, keys binary, counts binary")
    counts = stored(packed.groupBy("part").applyInArrow(_add, "part int, keys binary, counts binary"), "contexts")
    tops = counts.groupBy("part").applyInArrow(_tops, "node long, zeros long, ones long, weighted double")
    tops = tops.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("node").collect()
    top = top_levels(tops)
    n = counts.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    leaves = counts.groupBy("part").applyInArrow(_leaves(top), "keys binary, logs binary").collect() if n <= MOST_LEAVES else []
    sent = spark.sparkContext.broadcast((b"".join(bytes(r[0]) for r in leaves), b"".join(bytes(r[1]) for r in leaves)))
    scored = stored(texts.select("node", "text").mapInArrow(_score(sent, parts), SCORED), "scores")
    asked = scored.filter(F.col("part").isNotNull()).select("part", "nodes", "keys", "counts")
    answers = counts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_answer(top), "node long, log double")
    # a text may have been scored in several batches, always the same
    texts_of = lambda df: df.groupBy("node")
    times = texts_of(scored.filter(F.col("part").isNull())).agg(F.count(F.lit(1)).alias("times"), F.sum("log").alias("log"))
    more = texts_of(answers).agg(F.sum("log").alias("more"))
    return times.join(more, "node", "left").select("node", ((F.col("log") + F.coalesce("more", F.lit(0.0))) / F.col("times")).alias("log"))


WORDS = "part int, batch long, owners binary, words binary, counts binary, ids binary, nodes binary, held binary"
WORD_TYPES = [pa.int32(), pa.int64()] + [pa.binary()] * 6


def _words(parts: int):
    """Packed rows of a batch: for a part, (text, word, count); part -1 has the texts themselves."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            texts = batch.column(2).to_pylist()
            owners, words, counts, done = [], [], [], 0
            for _, held in chunked(np.arange(len(texts)), texts):
                data = np.frombuffer(b" ".join(held), np.uint8)
                start, end = word_bounds(data)
                w = Ranges(LOWER_SYMBOLS[data]).of(start, end)
                own = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in held[:-1]]), start, "right") - 1
                w, own = np.concatenate([w, np.repeat(END, len(held))]), np.concatenate([own, np.arange(len(held))])
                order = np.lexsort((w, own))
                w, own = w[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (own[1:] != own[:-1])]))
                owners.append((own[first] + done).astype("<u4")), words.append(w[first]), counts.append(np.diff(np.append(first, len(w))).astype("<u4"))
                done += len(held)
            if not texts:
                continue
            owner, word, count = np.concatenate(owners), np.concatenate(words), np.concatenate(counts)
            held = np.asarray(batch.column(3).to_pylist(), np.uint8)
            rows = [(-1, task + i, None, None, None, batch.column(0).to_numpy().tobytes(), batch.column(1).to_numpy().tobytes(), held.tobytes())]
            # a text's words of a part are listed by its place in the batch: how many, and then which
            for p, o, w, c in _by_part(((word & U64(0xFFFF)) % U64(parts)).astype(np.int64), parts, owner, word, count):
                each = np.bincount(np.frombuffer(o, "<u4"), minlength=len(texts)).astype("<u2" if len(word) < 65536 else "<u4")
                few = np.frombuffer(c, "<u4")
                narrow = few.astype("<u1") if few.max() < 256 else few
                rows.append((p, task + i, each.astype("<u4").tobytes(), w, bytes([narrow.itemsize]) + narrow.tobytes(), None, None, held.tobytes()))
            yield _batch(rows, "part batch owners words counts ids nodes held", WORD_TYPES)

    return f


COUNTED = "batch long, logs binary, tokens binary, known binary, ids binary, nodes binary, held binary, n long, distinct long"
COUNTED_TYPES = [pa.int64()] + [pa.binary()] * 6 + [pa.int64()] * 2


def _word_counts(table: pa.Table) -> pa.Table:
    """Counts of a part's words over the training texts, and for each batch what they give to its texts."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    if table.column("part")[0].as_py() < 0:
        n = table.num_rows
        return pa.table([table.column("batch"), *[pa.nulls(n, pa.binary())] * 3, *[table.column(c) for c in ("ids", "nodes", "held")], *[pa.nulls(n, pa.int64())] * 2], names=names)
    rows, words, counts, train = table.num_rows, [], [], []
    columns = {c: table.column(c).to_pylist() for c in ("batch", "owners", "words", "counts", "held")}
    owners = []
    for owner, w, c, held in zip(*[columns[x] for x in ("owners", "words", "counts", "held")], strict=True):
        each = np.frombuffer(owner, "<u4")
        owners.append(np.repeat(np.arange(len(each)), each))
        words.append(np.frombuffer(w, "<u8")), counts.append(np.frombuffer(c[1:], f"<u{c[0]}").astype(np.int64))
        train.append(np.frombuffer(held, np.uint8)[owners[-1]] == 0)
    word, count = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(word)
    first = runs(word[order])
    total = np.add.reduceat(np.where(np.concatenate(train), count, 0)[order], first)
    seen = np.empty(len(word), np.int64)
    seen[order] = np.repeat(total, np.diff(np.append(first, len(word))))
    out, at = [], 0
    for i in range(rows):
        here, c = seen[at : at + len(words[i])], counts[i]
        size = len(columns["owners"][i]) // 4
        add = lambda x: np.bincount(owners[i], weights=x, minlength=size)  # noqa: B023, E731
        out.append((columns["batch"][i], (add(c * np.log10(here + 1.0))).astype("<f8").tobytes(), add(c).astype("<i4").tobytes(), add(np.where(here > 0, c, 0)).astype("<i4").tobytes(), None, None, None, None, None))
        at += len(words[i])
    out.append((-1, None, None, None, None, None, None, int(total.sum()), int((total > 0).sum())))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(COUNTED_TYPES)], names=names)


BASE = "id long, node long, held_out boolean, n_tokens long, n_known long, logs double"


def _by_text(table: pa.Table) -> pa.Table:
    """Sum what the parts say about the texts of a batch."""
    logs, tokens, known, about = 0.0, 0, 0, None
    for i in range(table.num_rows):
        row = {c: table.column(c)[i].as_py() for c in ("logs", "tokens", "known", "ids", "nodes", "held")}
        if row["ids"] is not None:
            about = row
        else:
            logs, tokens, known = logs + np.frombuffer(row["logs"], "<f8"), tokens + np.frombuffer(row["tokens"], "<i4").astype(np.int64), known + np.frombuffer(row["known"], "<i4").astype(np.int64)
    columns = [np.frombuffer(about["ids"], "<i8"), np.frombuffer(about["nodes"], "<i8"), np.frombuffer(about["held"], np.uint8) > 0, tokens, known, logs]
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in BASE.split(", ")])


LAST = (1 << 63) - 1


def score_texts(documents: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of (doc_id, text).

    Both models learn from all rows where `held_out(doc_id)` does not hold (a null counts as false). Base: words in lower
    case A-Z and one end per text, each with log10((c + 1) / (N + V + 1)). Score: log10 of the probability that
    context-tree weighting gives to the text's bytes and then its end (see `tree_scores`); bits_per_byte is its code length.

    Null texts count as empty: one token, the end, which both models pay for (bits_per_byte is null). Repeated rows each give a row and each
    count in training. With nothing to learn from, c, N and V are 0 and every bit costs one bit. An empty table gives an empty result; other columns are not used.
    """
    parts = parts_of(documents.sparkSession)
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held"))
    keyed = keyed.withColumn("node", F.xxhash64("text"))
    scores = tree_scores(keyed, ~F.col("held"))
    packed = keyed.select("id", "node", "text", "held").mapInArrow(_words(parts), WORDS)
    spread = F.when(F.col("part") < 0, F.pmod("batch", F.lit(parts)))
    counted = stored(packed.groupBy("part", spread).applyInArrow(_word_counts, COUNTED), "words")
    n, v = counted.filter("batch < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    base = counted.filter("batch >= 0").groupBy("batch").applyInArrow(_by_text, BASE)
    sizes = keyed.groupBy("node").agg(F.max(F.octet_length("text")).alias("_bytes"))
    return base.join(scores.join(sizes, "node"), "node").select(
        F.nullif("id", F.lit(LAST)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("log") / LN10).alias("score"),
        F.when(F.col("_bytes") > 0, -F.col("log") / float(np.log(2.0)) / F.col("_bytes")).alias("bits_per_byte"),
    )
