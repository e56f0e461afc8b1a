"""Token ids of documents in files of Re-Pair grammars, and what is read back from them.

A shard is a run of at most `SHARD` token ids of consecutive documents. Its frequent pairs of neighbouring ids become
nonterminals, pairs of those too, until no pair is frequent. Its row holds the rules, the length each nonterminal expands to, the
sequence that is left and the documents' sizes, so any range of ids is decoded from the few symbols that cover it.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gaugeframe.llm.storage import stored

#: Ids of a shard, the id that ends a document, and how often a pair stands in a shard before a rule replaces it.
SHARD = 1 << 19
END = 2
LEAST = 6
#: Rounds end when one would replace less than this share of the sequence.
GAIN = 0.01
#: Different words whose ids a task keeps, and bytes of text it encodes at a time.
KNOWN = 1_500_000
TEXT_BYTES = 1 << 22

#: Letters, then signs, for which SPLITTER is known to make two pieces that do not depend on each other or on case.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*+,./:;=?@^_`~|-]*)")
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

FILES = (
    "part int, shard int, n_ids long, first_doc long, begun boolean, goes_on boolean, doc_ids array<bigint>, sizes array<int>, "
    "n_terminals int, lefts binary, rights binary, lengths binary, symbols binary"
)


# ---- the grammar ----


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs that start at places `at` are replaced: those with a lower rank than the pairs they overlap.

    In a run of overlapping equal pairs every other one is taken, from the left.
    """
    n = len(at)
    touch = np.diff(at) == 1
    new = np.ones(n, bool)
    new[1:] = ~touch | (rank[1:] != rank[:-1])
    place = np.arange(n, dtype=np.int32)
    key = 2 * rank + ((place - np.maximum.accumulate(np.where(new, place, 0))) & 1)
    good = np.ones(n, bool)
    good[1:] &= ~touch | (key[1:] < key[:-1])
    good[:-1] &= ~touch | (key[:-1] < key[1:])
    return good


def compress(ids: np.ndarray, sizes: np.ndarray, n_terminals: int, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(lefts, rights, lengths, symbols) of ids that are cut into documents of `sizes`; no symbol spans two documents.

    A round counts pairs in hashed slots and replaces the frequent ones; pairs that meet in a slot wait for the next round, which
    deals them anew. A pair that was not frequent cannot become so, so later rounds look at pairs with a new symbol and at
    those that were passed over.
    """
    x = ids.astype(np.int32)
    last = np.zeros(len(x), bool)
    ends = np.cumsum(sizes)
    last[ends[(ends > 0) & (ends <= len(x))] - 1] = True
    lefts, rights, top, turn = [], [], n_terminals, 0
    at = np.flatnonzero(~last[:-1])
    while len(at) > GAIN * len(x):
        pair = (x[at].astype(np.int64) << 32) | x[at + 1]
        bits = max(10, min(22, (2 * len(at)).bit_length()))
        salt = (0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        slot = ((pair.view(np.uint64) * np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int32)
        holder = np.zeros(1 << bits, np.int64)
        holder[slot] = pair
        mine = holder[slot] == pair
        count = np.bincount(slot[mine], minlength=1 << bits)
        frequent = np.flatnonzero(count >= least)
        frequent = frequent[np.lexsort((holder[frequent], -count[frequent]))]
        rank_of = np.full(1 << bits, -1, np.int32)
        rank_of[frequent] = np.arange(len(frequent))
        rank = np.where(mine, rank_of[slot], -1)
        can = rank >= 0
        place, rank = at[can], rank[can]
        good = _chosen(place, rank)
        place, rank = place[good], rank[good]
        used = np.bincount(rank, minlength=len(frequent)) >= 2
        good = used[rank]
        place, rank = place[good], rank[good]
        if len(place) <= GAIN * len(x):
            break
        rules = holder[frequent[used]]
        lefts.append(rules >> 32), rights.append(rules & 0xFFFFFFFF)
        waiting = np.zeros(len(x), bool)
        waiting[at[~mine | can]] = True
        waiting[place] = True
        waiting[place[place > 0] - 1] = True
        x[place] = (top + np.cumsum(used) - 1)[rank]
        last[place] = last[place + 1]
        stays = np.ones(len(x), bool)
        stays[place + 1] = False
        x, last, waiting = x[stays], last[stays], waiting[stays]
        # a replaced pair's left neighbour may have been the end of another replaced pair; its symbol waits as a new one
        at = np.flatnonzero(waiting[:-1] & ~last[:-1])
        top, turn = top + int(used.sum()), turn + 1
    lefts, rights = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (lefts, rights))
    lengths = np.ones(n_terminals + len(lefts), np.int64)
    begin = n_terminals
    while begin < len(lengths):  # a rule's parts have lower numbers, so whole runs of rules without mutual use go at once
        later = np.flatnonzero(np.maximum(lefts, rights)[begin - n_terminals :] >= begin)
        end = begin + int(later[0]) if len(later) else len(lengths)
        own = slice(begin - n_terminals, end - n_terminals)
        lengths[begin:end] = lengths[lefts[own]] + lengths[rights[own]]
        begin = end
    return tuple(v.astype("<u4") for v in (lefts, rights, lengths[n_terminals:], x))


def expand(symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, n_terminals: int) -> np.ndarray:
    """All ids of a sequence of symbols, by replacing nonterminals until none is left."""
    x = symbols
    while True:
        rule = x >= n_terminals
        if not rule.any():
            return x
        at = np.cumsum(rule) + np.arange(len(x)) - rule
        out = np.empty(int(len(x) + rule.sum()), np.int64)
        out[at[~rule]] = x[~rule]
        out[at[rule]], out[at[rule] + 1] = lefts[x[rule] - n_terminals], rights[x[rule] - n_terminals]
        x = out


def decode(lefts, rights, lengths, symbols, n_terminals: int, start: int, end: int) -> np.ndarray:
    """Ids from `start` up to `end` of a shard; only the symbols that cover them, and each rule they use once, are expanded."""
    if start >= end:
        return np.zeros(0, np.int64)
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= n_terminals
    size[rule] = lengths[symbols[rule] - n_terminals]
    ends = np.cumsum(size)
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    skipped, x, size = start - int(ends[low] - size[low]), symbols[low:high], size[low:high]
    used, which = np.unique(x, return_inverse=True)
    flat = expand(used, lefts, rights, n_terminals)
    whole = np.ones(len(used), np.int64)
    whole[used >= n_terminals] = lengths[used[used >= n_terminals] - n_terminals]
    first = np.cumsum(whole) - whole
    begin = np.cumsum(size) - size
    out = flat[np.arange(int(size.sum())) + np.repeat(first[which] - begin, size)]
    return out[skipped : skipped + end - start]


# ---- writing ----


def _letters_only(known: dict) -> dict | None:
    """The tokenizer without what leaves lower-case Latin letters as they are; None if it isn't known to treat PLAIN words so."""
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    same = (
        known["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, blank, {"type": "Lowercase"}]}
        and known["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLITTER}, "behavior": "Removed", "invert": True}, byte_level]}
        and not any(PLAIN.fullmatch(t["content"]) or not t["content"].strip() or set(t["content"]).isdisjoint("<>'") for t in known["added_tokens"])
    )
    if not same:
        return None
    return known | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}


class WordIds:
    """Ids of texts by a tokenizer that drops white space, each different word encoded once.

    White space (blank, tab, line ends) separates words for such a tokenizer, so a text's ids are those of its words in a row.
    Words are encoded many at a time. Plain ones (A-Z and a-z alone) are told apart by the ids that end a word, others by a
    special token of the tokenizer that is set between them. If the tokenizer is known to lower-case letters and to cut signs
    off them, letters are encoded once for all words that differ in case or in the signs that follow.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = json.loads(model)
        self.encode = Tokenizer.from_str(model).encode_batch_fast
        mark = next((t for t in known["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])), None)
        self.mark, self.mark_id = (mark["content"], mark["id"]) if mark else (None, None)
        letters = _letters_only(known)
        self.encode_letters = Tokenizer.from_str(json.dumps(letters)).encode_batch_fast if letters else None
        suffix, words = known["model"].get("end_of_word_suffix"), known["model"]["vocab"]
        self.ends = np.zeros(1 + max([*words.values(), *[t["id"] for t in known["added_tokens"]]]), bool)
        self.ends[[i for w, i in words.items() if suffix and w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.first, self.flat, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def _joined(self, encode: Callable, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids in a row, how many each word has), if the ids that end a word tell the words apart."""
        flat = np.array(encode([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends[flat])
        return (flat, np.diff(ends, prepend=-1)) if len(ends) == len(words) and ends[-1] == len(flat) - 1 else None

    def _ids(self, words: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each word has)."""
        if kind != "other" and (found := self._joined(self.encode_letters if kind == "letters" else self.encode, words)):
            return found
        if self.mark is None or any(self.mark[:2] in w for w in words):
            ids = [e.ids for e in self.encode(words, add_special_tokens=False)]
            return np.fromiter((t for e in ids for t in e), np.int32), np.array([len(e) for e in ids], np.int64)
        flat = np.array(self.encode([self.mark.join(words)], add_special_tokens=False)[0].ids + [self.mark_id], np.int32)
        marks = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.diff(marks, prepend=-1) - 1

    def _keep(self, words: list[str], flat: np.ndarray, sizes: list[np.ndarray]) -> None:
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        known = len(self.size)
        self.place.update(zip(words, range(known, known + len(words)), strict=True))
        self.size = np.concatenate([self.size, *sizes])
        self.first = np.cumsum(self.size) - self.size

    def _encode(self, words: list[str], kind: str) -> None:
        pieces = [self._ids(words[i : i + 1024], kind) for i in range(0, len(words), 1024)]
        if pieces:
            self._keep(words, np.concatenate([flat for flat, _ in pieces]), [size for _, size in pieces])

    def _at(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, where each word ends) of known words by place."""
        size = self.size[which]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[which] - (ends - size), size)
        return self.flat[at], ends

    def _learn(self, words: list[str]) -> None:
        place, rest = self.place, words
        plain, letters, signs = [], [], []  # lists of strings side by side: many tuples would keep the garbage collector busy
        if self.encode_letters:
            rest = []
            for w in words:
                m = PLAIN.fullmatch(w)
                if m:
                    plain.append(w), letters.append(m[1].lower()), signs.append(m[2])
                else:
                    rest.append(w)
            self._encode([w for w in dict.fromkeys(letters) if w not in place], "letters")
            rest = list(dict.fromkeys([*rest, *[w for w in dict.fromkeys(signs) if w and w not in place]]))
        self._encode([w for w in rest if w.isascii() and w.isalpha()], "ascii")
        self._encode([w for w in rest if not (w.isascii() and w.isalpha())], "other")
        at = np.fromiter(map(place.__getitem__, letters), np.int64, len(letters))
        bare = [i for i, w in enumerate(signs) if not w]
        place.update(zip([plain[i] for i in bare], at[bare].tolist(), strict=True))
        ended = [i for i, w in enumerate(signs) if w]
        if ended:
            flat, ends = self._at(np.stack([at[ended], [place[signs[i]] for i in ended]], axis=1).ravel())
            self._keep([plain[i] for i in ended], flat, [np.diff(ends[1::2], prepend=0)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        bounds = np.cumsum([0] + [t.count(" ") + 1 for t in texts])
        words = " ".join(texts).split(" ")
        if len(self.place) > KNOWN:
            self.forget()
        which = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(which < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)))
            which[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        flat, ends = self._at(which)
        return flat, np.diff(np.concatenate([[0], ends])[bounds])


_ENCODERS: dict[str, WordIds] = {}


def encoder(model: str) -> WordIds:
    """The encoder of this Python worker; the tasks it runs one after another share the words it knows."""
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = WordIds(model)
    return _ENCODERS[model]


def _pieces(texts: Iterable[tuple[int | None, str]], encode: Callable, end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, sizes) of some documents at a time, each ended by `end`."""

    def encoded(held):
        ids, sizes = encode([t for _, t in held])
        out = np.full(len(ids) + len(held), end, np.int64)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(held)), sizes)] = ids
        return [d for d, _ in held], out, sizes + 1

    held, volume = [], 0
    for doc_id, text in texts:
        held.append((doc_id, text))
        volume += len(text)
        if volume >= TEXT_BYTES:
            yield encoded(held)
            held, volume = [], 0
    if held:
        yield encoded(held)


def _write_rows(model: str, n_terminals: int, end: int, most: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(model)
        shard, first_doc, begun = 0, 0, False
        docs, sizes, ids, filled = [], [], [], 0

        def row(goes_on: bool) -> pa.RecordBatch:
            flat, cut = np.concatenate(ids), np.array(sizes, np.int64)
            grammar = compress(flat, cut if not goes_on else cut[:-1], n_terminals)
            cells = [part, shard, filled, first_doc, begun, goes_on, docs, sizes, n_terminals, *[v.tobytes() for v in grammar]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in FILES.split(", ")])

        texts = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for some, flat, counts in _pieces(texts, encode, end):
            begin = 0
            for doc_id, count in zip(some, counts.tolist(), strict=True):
                docs.append(doc_id), sizes.append(0)
                while count:
                    take = min(count, most - filled)
                    ids.append(flat[begin : begin + take])
                    sizes[-1] += take
                    begin, count, filled = begin + take, count - take, filled + take
                    if filled == most:
                        yield row(count > 0)
                        first_doc += len(docs) - (count > 0)
                        begun = count > 0
                        shard, docs, sizes, ids, filled = shard + 1, [doc_id] if count else [], [0] if count else [], [], 0
        if filled:
            yield row(False)

    return f


def write_ids(documents: DataFrame, path: str, model: str, end: int = END, shard: int = SHARD) -> None:
    """Encode every whole text of (doc_id, text), append `end`, and write shards of ids in ascending doc_id order.

    `model` is a tokenizer's JSON (a public vocabulary, so its size is fixed); it must drop white space. Null texts are empty,
    null doc_ids come first, rows of one doc_id lie by the hash of their texts and then by the text; equal rows are written each.
    The range partitions are salted beyond the doc_id, so a doc_id with many rows takes many tasks; a long text is cut over shards.
    """
    known = json.loads(model)
    n_terminals = 1 + max(end, *known["model"]["vocab"].values(), *[t["id"] for t in known["added_tokens"]])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    keys = ["doc_id", "_hash", "_row"]
    # the row number only spreads equal rows over tasks: rows that differ in text but not in hash are the same to a reader of the order
    placed = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    written = placed.select("doc_id", "text").mapInArrow(_write_rows(model, n_terminals, end, shard), FILES)
    written.write.option("compression", "zstd").parquet(path)


# ---- reading ----


def _grammar(batch: pa.RecordBatch, i: int):
    names = batch.schema.names
    column = lambda c: batch.column(names.index(c))[i].as_py()
    return column, [np.frombuffer(column(c), "<u4").astype(np.int64) for c in ("lefts", "rights", "lengths", "symbols")]


PIECES = "part int, shard int, doc long, whole boolean, doc_id long, offset long, n_tokens long, crc long"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and crc32 of each document's ids in each shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            get, grammar = _grammar(batch, i)
            sizes, terminals = np.array(get("sizes"), np.int64), get("n_terminals")
            ids = decode(*grammar, terminals, 0, get("n_ids")).astype("<u4")
            ends = np.cumsum(sizes)
            data = ids.tobytes()
            crcs = [zlib.crc32(data[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            n, first = len(sizes), get("first_doc")
            whole = np.ones(n, bool)
            whole[-1] &= not get("goes_on")
            whole[0] &= not get("begun")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, get("part"), np.int32)), pa.array(np.full(n, get("shard"), np.int32)), pa.array(first + np.arange(n)), pa.array(whole),
                 pa.array(get("doc_ids"), pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )


def _shift(crc: int, n_bytes: int) -> int:
    """The effect of `n_bytes` zero bytes on a crc32, by squaring the shift of one zero bit."""
    times = lambda m, v: _xor(m[b] for b in range(32) if v >> b & 1)
    matrix = [0xEDB88320] + [1 << b for b in range(31)]  # one zero bit
    n = 8 * n_bytes
    while n:
        if n & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, m) for m in matrix]
        n >>= 1
    return crc


def _xor(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def joined_crc(pieces: Iterable[tuple[int, int]]) -> int:
    """crc32 of byte strings in a row from (crc32, length) of each."""
    out = 0
    for crc, n in pieces:
        out = _shift(out, n) ^ crc
    return out


@F.pandas_udf(LongType())
def _joined(pieces: pd.Series) -> pd.Series:
    return pd.Series([joined_crc((p["crc"], 4 * p["n_tokens"]) for p in held) for held in pieces], dtype="int64")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    `start` counts the ids of all documents before: running sums over the shards of a part and over the parts. Sizes of
    documents in several shards are added and their crc32 combined; no document is put together.
    """
    shards = spark.read.schema(FILES).parquet(path)
    earlier = lambda by, at: Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "n_ids")
    inside = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier("part", "shard")), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for a written file
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(F.lit(0), "part")), F.lit(0)).alias("base"))
    starts = inside.join(parts, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("first"))
    pieces = stored(shards.mapInArrow(_digests, PIECES), "pieces")  # two branches read them, so that files are decoded once
    placed = pieces.join(starts, ["part", "shard"]).withColumn("start", F.col("first") + F.col("offset"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = placed.filter("whole").withColumnRenamed("crc", "ids_crc32").select(*columns)
    cut = placed.filter("NOT whole").groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("shard", "n_tokens", "crc"))).alias("pieces"),
    )
    return whole.union(cut.withColumn("ids_crc32", _joined("pieces")).select(*columns))


IDS = "part int, doc long, shard int, doc_id long, ids array<int>"


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(part, doc, shard, doc_id, ids) of the documents whose doc_id is in `wanted`: a row for each shard a document is in.

    Only those documents are decoded, from the symbols that cover them. Put together by (part, doc), in the order of shard.
    """
    shards = spark.read.schema(FILES).parquet(path)
    listed = shards.select("part", "shard", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = listed.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    places = places.groupBy("part", "shard").agg(F.collect_list("place").alias("places"))  # no more than a shard's documents

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get, grammar = _grammar(batch, i)
                sizes, doc_ids, at = np.array(get("sizes"), np.int64), get("doc_ids"), sorted(get("places"))
                ends = np.cumsum(sizes)
                ids = [decode(*grammar, get("n_terminals"), int(ends[d] - sizes[d]), int(ends[d])).astype(np.int32) for d in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get("part")] * len(at), pa.int32()), pa.array([get("first_doc") + d for d in at], pa.int64()),
                     pa.array([get("shard")] * len(at), pa.int32()), pa.array([doc_ids[d] for d in at], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=[c.split()[0] for c in IDS.split(", ")],
                )

    return shards.join(places, ["part", "shard"]).mapInArrow(decoded, IDS)


def public_model(path: str | None = None) -> str:
    """JSON of the tokenizer at `path`; without one, of the installed public vocabulary `word_bpe_49k.json`."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()
