"""Spelling variants of a vocabulary: words one edit from a far more frequent word, by a reduced alphabet.

Letters are hashed to `SYMBOLS` symbols, so a word has a reduced word, and words one edit apart have reduced words at most one edit
apart. The full one-edit neighbourhood of every reduced word that occurs is generated and joined with the reduced words that occur;
the words behind such a pair are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import BASE, U64, Ranges, mixed, runs
from gaugeframe.llm.storage import stored

#: Symbols of the reduced alphabet. More of them generate more neighbours and leave fewer words to compare.
SYMBOLS = 8
#: Words of a block: those of a reduced word that many words share are compared block by block, in different tasks.
BLOCK = 256
#: Pairs of words that are looked at, and letters that are compared, at once.
PAIRS, CELLS = 1 << 19, 1 << 21
#: Rows of a generated batch.
ROWS = 1 << 17
SHORTEST, FEWEST, FAR_MORE = 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
SYMBOL_CODES = mixed(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(BASE))


# ---- the vocabulary ----


def misspelt_words(documents: DataFrame) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased; about one of 199 runs, by a hash of it and its doc_id, loses a letter.

    A null text has no runs; a null doc_id is hashed as `null`. Counts are combined in the tasks before words are shuffled.
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    size = F.length("run")
    found = found.filter(size >= SHORTEST)  # no run gets longer
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % size).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    word = F.when(h % 199 == 0, without).otherwise(F.col("run"))
    return found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---- reduced words ----


def _reduced(letters: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    return (mixed(letters.astype(U64)) % U64(SYMBOLS)).astype(np.int64)


def _letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")


def reduced_key(words: list[str]) -> np.ndarray:
    """A 64-bit name of the reduced word of each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    if not len(words):
        return np.zeros(0, U64)
    return Ranges(SYMBOL_CODES[_reduced(_letters("".join(words)))]).of(ends - sizes, ends)


def neighbourhood(word: str) -> np.ndarray:
    """Names of all reduced words that are at most one edit from the reduced word of `word`."""
    symbols = _reduced(_letters(word))
    n = len(symbols)
    hashed = SYMBOL_CODES[symbols]
    ranges = Ranges(hashed)
    up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n + 1, BASE, U64), dtype=U64)])
    total = ranges.sums
    # Ranges.of(0, n) is mixed(sum of symbol i times base to the i, plus n); an edit moves the part behind it by one power
    name = lambda value, size: mixed(value + U64(size))
    inverse = ranges.down[1] if n else U64(1)
    behind = total[n] - total  # symbols i.. in place
    place = np.arange(n)
    deleted = name(total[:-1] + behind[1:] * inverse, n - 1)
    replaced = name((total[n] - hashed * up[:n])[:, None] + SYMBOL_CODES[None, :] * up[:n, None], n)
    inserted = name((total + behind * U64(BASE))[:, None] + SYMBOL_CODES[None, :] * up[: n + 1, None], n + 1)
    return np.unique(np.concatenate([name(total[n:], n), deleted[place], replaced.ravel(), inserted.ravel()]))


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(reduced_key(batch.column(0).to_pylist()).view(np.int64)), batch.column(0), batch.column(1)], names=["key", "word", "n"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, other) for each reduced word `key`, with one of its words, and each name in its neighbourhood."""

    def rows(keys, others):
        at = np.repeat(np.array(keys, np.int64), [len(o) for o in others])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(others).view(np.int64))], names=["key", "other"])

    for batch in batches:
        keys, others, size = [], [], 0
        for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            near = neighbourhood(word)
            for i in range(0, len(near), ROWS):
                keys.append(key), others.append(near[i : i + ROWS])
                size += len(others[-1])
                if size >= ROWS:
                    yield rows(keys, others)
                    keys, others, size = [], [], 0
        if keys:
            yield rows(keys, others)


# ---- comparison of words ----


def one_edit(letters: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the words that begin at places a and b of `letters` differ by one edit: what they share in front and behind leaves one letter."""
    longer, shorter = np.maximum(a_size, b_size), np.minimum(a_size, b_size)
    place = np.arange(int(shorter.max(initial=0)))[None, :]
    both = place < shorter[:, None]

    def shared(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        same = (letters[np.where(both, x[:, None] + step * place, 0)] == letters[np.where(both, y[:, None] + step * place, 0)]) & both
        return np.where(same.all(axis=1), shorter, (~same).argmax(axis=1)) if place.size else shorter

    front, back = shared(a, b, 1), shared(a + a_size - 1, b + b_size - 1, -1)
    return (longer - shorter <= 1) & (front + back >= longer - 1) & ~((a_size == b_size) & (front == a_size))


class Words:
    """The words of a list column, one after another."""

    def __init__(self, column: pa.ListArray):
        self.words = column.flatten()
        held = self.words.to_pylist()
        self.letters = _letters("".join(held))
        self.size = np.array([len(w) for w in held], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        lists = np.diff(column.offsets.to_numpy())
        self.lists, self.first = lists, np.cumsum(lists) - lists
        # an edit changes the first three letters of a word or the last three, not both, if the word has six
        packed = lambda at: sum(self.letters[at + i].astype(np.int64) << (21 * i) for i in range(3))
        long_ = self.size >= SHORTEST
        self.head, self.tail = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        self.head[long_], self.tail[long_] = packed(self.begin[long_]), packed((self.begin + self.size)[long_] - 3)


NEAR = "word string, other string, n long"


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words (word, other, count of other) from rows with two blocks of words and the counts of the second."""
    for batch in batches:
        a, b = Words(batch.column(0)), Words(batch.column(1))
        letters = np.concatenate([a.letters, b.letters])
        pairs = a.lists * b.lists
        # some rows at a time, and of these some pairs at a time
        row_cuts = np.append(runs(np.cumsum(pairs) // PAIRS), len(pairs))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in zip(row_cuts, row_cuts[1:]):
            row = np.repeat(np.arange(low, high), pairs[low:high])
            k = np.arange(len(row)) - np.repeat(np.cumsum(pairs[low:high]) - pairs[low:high], pairs[low:high])
            x, y = a.first[row] + k // b.lists[row], b.first[row] + k % b.lists[row]
            shorter = np.minimum(a.size[x], b.size[y])
            maybe = (np.abs(a.size[x] - b.size[y]) <= 1) & ((a.head[x] == b.head[y]) | (a.tail[x] == b.tail[y]) | (shorter < SHORTEST))
            x, y, shorter = x[maybe], y[maybe], shorter[maybe]
            order = np.argsort(shorter, kind="stable")
            x, y, shorter = x[order], y[order], shorter[order]
            # words of about one length together, so that none is laid out in the width of a far longer one
            cuts = np.append(runs((np.cumsum(shorter) // CELLS) * 64 + np.ceil(np.log2(shorter + 1)).astype(np.int64)), len(x))
            for i, j in zip(cuts, cuts[1:]):
                p, q = x[i:j], y[i:j]
                near = one_edit(letters, a.begin[p], a.size[p], len(a.letters) + b.begin[q], b.size[q])
                found.append((p[near], q[near]))
        if found:
            x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([a.words.take(pa.array(x)), b.words.take(pa.array(y)), batch.column(2).flatten().take(pa.array(y))], names=["word", "other", "n"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form {n, word}): how many words are one edit from a word, and the most frequent of them (ties: the least).

    Words are dealt to blocks of their reduced word, so a reduced word with any number of words is compared block by block. Words
    without a near word have no row.
    """
    keyed = stored(vocabulary.select("word", "n").mapInArrow(_keys, "key long, word string, n long"), "keyed")
    classes = keyed.groupBy("key").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("size"))
    blocks = keyed.join(classes.select("key", F.ceil(F.col("size") / BLOCK).alias("n_blocks")), "key")
    blocks = blocks.withColumn("block", F.when(F.col("n_blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("n_blocks"))))
    blocks = stored(blocks.groupBy("key", "block").agg(F.collect_list(F.struct("word", "n")).alias("held")), "blocks")
    near = classes.select("key", "word").mapInArrow(_neighbours, "key long, other long")
    pairs = near.join(classes.select(F.col("key").alias("other")), "other", "left_semi")
    first = blocks.select("key", F.col("held").alias("a"))
    second = blocks.select(F.col("key").alias("other"), F.col("held").alias("b"))
    sides = pairs.join(first, "key").join(second, "other").select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    found = sides.mapInArrow(_compared, NEAR)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("word"))).alias("best")
    merged = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    return merged.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling; a chain has as many words as counts grow fivefold."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.filter("moved").limit(1).count():
            return steps.select("word", "root")


def variants(vocabulary: DataFrame, far_more: int = FAR_MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    The form of a word is its most frequent near word (ties: least in code-point order) if that has `far_more` times its count, else
    null; the root is where forms lead in the end, the word itself without a form. Words are compared as code points.
    """
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary)
    told = vocabulary.join(near, "word", "left")
    far = F.col("form.n") >= far_more * F.col("n")
    told = stored(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("form.word")).alias("form"), F.when(far, F.col("form.n")).alias("form_n")),
        "forms",
    )
    ends = roots(told.filter(F.col("form").isNotNull()).select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def common(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """Words of `shortest` code points and `fewest` occurrences at least."""
    enough: Column = (F.length("word") >= shortest) & (F.col("n") >= fewest)
    return words.filter(enough)
