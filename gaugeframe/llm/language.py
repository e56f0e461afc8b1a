"""The language of a text, by unigrams of pieces summed over all segmentations of its words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import U64, batchwise, mixed
from gaugeframe.llm.context_trees import Table
from gaugeframe.llm.storage import stored

#: A public vocabulary, read on the driver.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
#: Runs of letters up to this length are summed in probabilities, which do not underflow there; longer ones in logarithms.
SHORT = 32
#: Letters of a longer run whose pieces are looked up at a time, and longer runs summed side by side.
BLOCK, ABREAST = 1024, 64
#: Different texts of a language that the probabilities are fitted on, at most (in expectation, by a hash of the text).
FIT_ROWS = 1500
ROUNDS = 3
SMOOTHING = 0.02
#: Logs of probabilities are summed as whole numbers, times the scale and LOG; that of a letter's piece is far above -1 / LOG.
LOG = 2.0**-8
UNDEFINED = "und"
#: A text is foreign to a language if its log probability is lower than that of as many letters of the training words by
#: more than FAR a letter and SLACK besides. Held-out invented prose lies 1.1 a letter below at most, plain English 2, Polish
#: 3.5, Russian 6, random letters 6 and unseen letters 13; the slack keeps one or two unseen letters from deciding.
FAR = 4.0
SLACK = 20.0
Model = tuple[list[str], list[str], np.ndarray, np.ndarray]
#: Letters of the words that a task remembers; when there are more it starts afresh.
REMEMBERED = 8_000_000


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of letters only, in lower case, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if LETTERS.fullmatch(p))


def runs_of_letters(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * 0x100000001B3 + ord(c) + 1) & (2**64 - 1)
    return h


class Pieces:
    """The lattice of pieces of many words at once. A letter that is no piece stands for itself, as the piece `unknown`."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces) + 1  # the last is `unknown`
        self.longest = max(map(len, pieces), default=1)
        self.table = Table(mixed(np.array([_hash(p) for p in pieces], U64)), np.arange(len(pieces), dtype=np.float32))

    def lattice(self, words: list[str], width: int) -> list[np.ndarray]:
        """pieces[l][w, i] is the piece of l + 1 letters from letter i of word w, or -1; no word has more than `width` letters."""
        data = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
        letters = np.frombuffer(data, "<u4").reshape(len(words), width).astype(U64)
        ends = np.array([len(w) for w in words])[:, None]
        h, pieces = np.zeros_like(letters), []
        for n in range(1, min(self.longest, width) + 1):
            h = h[:, : width - n + 1] * U64(0x100000001B3) + letters[:, n - 1 :] + U64(1)
            inside = np.arange(width - n + 1)[None, :] + n <= ends
            value, known = self.table.get(mixed(h[inside]))
            found = np.full(h.shape, -1, np.int32)
            found[inside] = np.where(known, value.astype(np.int32), self.n - 1 if n == 1 else -1)
            pieces.append(found)
        return pieces

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(places, lengths, pieces) of words of at most SHORT letters."""
        lengths = np.array([len(w) for w in words])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(which), 1 << 15):
                some = which[at : at + (1 << 15)]
                yield some, lengths[some], self.lattice([words[i] for i in some], high)

    def forward(self, ends: np.ndarray, pieces: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """alpha[i, w, l]: probability of the first i letters of word w in language l, over all segmentations; p has a last row of zeros."""
        width = pieces[0].shape[1]
        alpha = np.zeros((width + 1, len(ends), p.shape[1]))
        alpha[0] = 1.0
        for i in range(1, width + 1):
            for n in range(1, min(len(pieces), i) + 1):
                alpha[i] += p[pieces[n - 1][:, i - n]] * alpha[i - n]
        return alpha

    def long_groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """(places, lengths, words) of words of more letters, those of similar length together."""
        lengths = np.array([len(w) for w in words])
        which = np.flatnonzero(lengths > SHORT)
        which = which[np.argsort(lengths[which], kind="stable")]
        for at in range(0, len(which), ABREAST):
            some = which[at : at + ABREAST]
            yield some, lengths[some], [words[i] for i in some]

    def block(self, words: list[str], at: int, size: int) -> np.ndarray:
        """pieces[l, w, i] from letter at + i, for i below `size`."""
        width = size + self.longest - 1
        return np.stack([found[:, :size] for found in self.lattice([w[at : at + width] for w in words], width)])

    def forward_logs(self, words: list[str], ends: np.ndarray, logs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(at, size, alpha) by blocks of letters: alpha[i] is the log of `forward` after at + i letters, for i up to `size`."""
        state = np.full((self.longest + 1, len(words), logs.shape[1]), -np.inf)
        state[0] = 0.0
        for at in range(0, int(ends.max()), BLOCK):
            size = min(BLOCK, int(ends.max()) - at)
            pieces = self.block(words, at, size)
            alpha = np.full((size + self.longest + 1, *state.shape[1:]), -np.inf)
            alpha[: len(state)] = state
            for i in range(size):
                ahead = alpha[i + 1 : i + 1 + self.longest]
                np.logaddexp(ahead, alpha[i] + logs[pieces[:, :, i]], out=ahead)
            yield at, size, alpha
            state = alpha[size:]

    def word_logs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), p.shape[1]))
        for some, ends, pieces in self.groups(words):
            alpha = self.forward(ends, pieces, p)
            out[some] = np.log(np.maximum(alpha[ends, np.arange(len(ends))], 1e-300))
        logs = _logs(p)
        for some, ends, group in self.long_groups(words):
            for at, size, alpha in self.forward_logs(group, ends, logs):
                here = np.flatnonzero((ends > at) & (ends <= at + size))
                out[some[here]] = alpha[ends[here] - at, here]
        return out

    def _expect(self, ends: np.ndarray, pieces: list[np.ndarray], counts: np.ndarray, p: np.ndarray, expected: np.ndarray) -> None:
        """Add to `expected` how often each piece stands in the words, over all segmentations, in whole numbers."""
        alpha = self.forward(ends, pieces, p)[:, :, 0]
        width, each = pieces[0].shape[1], np.arange(len(ends))
        beta = np.zeros((width + 1, len(ends)))
        beta[ends, each] = 1.0
        inverse = 1 / np.maximum(alpha[ends, each], 1e-300)
        for i in range(width - 1, -1, -1):
            for n in range(1, min(len(pieces), width - i) + 1):
                which = pieces[n - 1][:, i]
                through = p[which, 0] * beta[i + n]
                beta[i] += through
                np.add.at(expected, which, _whole(alpha[i] * through * inverse * counts))

    def _expect_logs(self, words: list[str], ends: np.ndarray, counts: np.ndarray, p: np.ndarray, expected: np.ndarray) -> None:
        """The same for long words. Sums of beginnings are kept; pieces are looked up again on the way back."""
        logs, total, kept = _logs(p), np.zeros(len(words)), []
        for at, size, alpha in self.forward_logs(words, ends, logs):
            here = np.flatnonzero((ends > at) & (ends <= at + size))
            total[here] = alpha[ends[here] - at, here, 0]
            kept.append((at, size, alpha[:size, :, 0].copy()))
        state = np.full((self.longest + 1, len(words)), -np.inf)
        for at, size, alpha in reversed(kept):
            pieces = self.block(words, at, size)
            beta = np.full((size + self.longest + 1, len(words)), -np.inf)
            beta[size:] = state
            here = np.flatnonzero((ends > at) & (ends <= at + size))
            beta[ends[here] - at, here] = 0.0
            for i in range(size - 1, -1, -1):
                through = logs[pieces[:, :, i], 0] + beta[i + 1 : i + 1 + self.longest]
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(through, axis=0))
                np.add.at(expected, pieces[:, :, i], _whole(np.exp(alpha[i] + through - total) * counts))
            state = beta[: self.longest + 1]

    def expect(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece stands in the words, `counts` times each, over all segmentations, in whole numbers."""
        expected = np.zeros(self.n + 1, np.int64)
        for some, ends, pieces in self.groups(words):
            self._expect(ends, pieces, counts[some], p, expected)
        for some, ends, group in self.long_groups(words):
            self._expect_logs(group, ends, counts[some], p, expected)
        return expected

    def fit(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Piece probabilities of one language by expectation maximisation over all segmentations of its words."""
        scale = _scale(int(counts @ np.array([len(w) for w in words])))
        return _rounds(self.n, 1, lambda p: self.expect(words, counts * scale, p)[:, None] / scale)[:, 0]


def _rounds(n: int, langs: int, expect: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Probabilities of n pieces, and a last row of zeros, after ROUNDS of `expect`, which gives their numbers by language."""
    p = np.full((n + 1, langs), 1.0 / n)
    p[-1] = 0.0
    for _ in range(ROUNDS):
        expected = expect(p)[:n] + SMOOTHING
        p[:n] = expected / expected.sum(axis=0)
    return p


def _scale(letters: int) -> float:
    """What numbers of pieces in so many letters are multiplied by, so that as whole numbers they just fit. Their sums do not
    depend on the order, hence not on how words are dealt to tasks."""
    return 2.0 ** (61 - letters.bit_length())


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.int64)


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in runs_of_letters(text):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _by_language(batches: Iterable[pa.RecordBatch], place: dict[str, int]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(place of the language, words, counts) of each batch of (lang, word, n)."""
    for batch in batches:
        langs, words, n = np.array([place[x] for x in batch.column(0).to_pylist()]), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
        for i in np.unique(langs):
            some = np.flatnonzero(langs == i)
            yield int(i), [words[k] for k in some], n[some]


def _expected(lattice, place: dict[str, int], scales: list[float], p):
    """Numbers of pieces, times the language's scale, in a task's words."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for i, words, n in _by_language(batches, place):
            found = lattice.value.expect(words, n * scales[i], p.value[:, [i]])
            sums[i] = sums[i] + found if i in sums else found
        for i, expected in sums.items():
            some = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(expected[some])], names=["lang", "piece", "e"])

    return f


def _total_logs(lattice, place: dict[str, int], scales: list[float], p):
    """The log probability, times the language's scale, of a task's words; LOG leaves room for their size."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, words, n in _by_language(batches, place):
            logs = _whole(n * scales[i] * LOG * lattice.value.word_logs(words, p.value[:, [i]])[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(logs.sum())], pa.int64())], names=["lang", "e"])

    return f


def fit(documents: DataFrame, training: Column, path: str = VOCABULARY, fit_rows: int = FIT_ROWS) -> Model:
    """(languages, pieces, probabilities, usual) from the text and lang of rows where `training` holds.

    `usual` is the mean log probability of a letter in the training words of each language, -inf where none were drawn.

    Different texts are counted by language first; of each, about `fit_rows` (those with the least hashes) give their words, with
    all their copies. So copies leave no language empty. The words with their counts are stored, and tasks find the expected
    numbers of pieces in them, once a round. What comes to the driver is these numbers, as many as pieces and languages; no text
    and no word does.
    """
    rows = documents.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r[0]: r[1] for r in rows.select("lang", F.xxhash64("text")).distinct().groupBy("lang").count().collect()}
    if not sizes:
        return [], [], np.zeros((1, 0)), np.zeros(0)
    share = F.element_at(F.create_map(*chain(*[(F.lit(k), F.lit(min(1.0, fit_rows / n))) for k, n in sizes.items()])), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * float(1 << 30))
    counts = chosen.mapInArrow(batchwise(_count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # of a part, words of a language are looked up side by side
    counts = stored(counts.sortWithinPartitions("lang", "word"), "words")
    letters = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum(F.col("n") * F.length("word"))).collect()}
    pieces, langs = vocabulary(path), sorted(sizes)
    total, place = [letters.get(k, 0) for k in langs], {k: i for i, k in enumerate(langs)}
    scales, context = [_scale(n) for n in total], documents.sparkSession.sparkContext
    lattice = Pieces(pieces)
    n, sent_lattice = lattice.n, context.broadcast(lattice)

    def expect(p: np.ndarray) -> np.ndarray:
        sent = context.broadcast(p)  # pieces times languages
        found = counts.mapInArrow(batchwise(_expected(sent_lattice, place, scales, sent)), "lang int, piece int, e long").groupBy("lang", "piece").agg(F.sum("e").alias("e")).toArrow()
        sent.destroy()
        expected = np.zeros((n + 1, len(langs)))
        expected[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["e"].to_numpy()
        return expected / np.array(scales)

    p = _rounds(n, len(langs), expect)
    sent = context.broadcast(p)
    logs = counts.mapInArrow(batchwise(_total_logs(sent_lattice, place, scales, sent)), "lang int, e long").groupBy("lang").agg(F.sum("e")).collect()
    sent.destroy()
    sent_lattice.destroy()
    usual = np.full(len(langs), -np.inf)
    for i, e in logs:
        usual[i] = e / scales[i] / LOG / total[i]
    return langs, pieces, p, usual


def _places() -> dict[str, int]:
    """Gives each word that is asked for the first time the next place, so a word is looked up once."""
    return defaultdict(count().__next__)


def _predict(sent, text_of: Callable[[pa.RecordBatch], pa.Array]):
    """Batches with the language of each row's text; the text is sent once, as one of the row's columns."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p, usual = sent.value
        lattice, place, logs, letters = Pieces(pieces), _places(), np.zeros((0, len(langs))), 0
        for batch in batches:
            column = text_of(batch)
            preds, scores, likely = [], [], []
            for at in range(0, len(column), 500):
                texts = [runs_of_letters(t) for t in column.slice(at, 500).to_pylist()]
                if letters > REMEMBERED:
                    place, logs, letters = _places(), logs[:0], 0
                rows = [np.fromiter(map(place.__getitem__, t), np.int64, len(t)) for t in texts] if langs else texts
                new = list(islice(place, len(logs), None))
                if new:
                    letters += sum(map(len, new))
                    logs = np.concatenate([logs, lattice.word_logs(new, p)])
                for words, row in zip(texts, rows, strict=True):
                    if not words or not langs:
                        preds.append(UNDEFINED), scores.append(0.0), likely.append(bool(words))
                        continue
                    total = logs[row].sum(axis=0)
                    chance = np.exp(total - total.max())
                    best = int(np.argmax(total))
                    preds.append(langs[best]), scores.append(float(chance[best] / chance.sum()))
                    likely.append(bool((total >= (usual - FAR) * sum(map(len, words)) - SLACK).any()))
            columns = batch.columns + [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(likely, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score", "_likely"])

    return f


def _told(inner: DataFrame, model: Model, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    sent = inner.sparkSession.sparkContext.broadcast(model)  # pieces times languages
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields] + ["lang_pred string", "score double", "_likely boolean"])
    return inner.mapInArrow(batchwise(_predict(sent, text_of)), schema)


def _text_at(documents: DataFrame) -> int:
    return [c.lower() for c in documents.columns].index("text")


def likely(documents: DataFrame, model: Model) -> DataFrame:
    """Documents, all columns, that have a letter and are not foreign (see FAR) to all learned languages.

    Where no language was learned, or no words of one were drawn, nothing is foreign and all texts with a letter stay.
    """
    named, place = [f"`{c}`" for c in documents.columns], _text_at(documents)
    kept = _told(documents.select(F.struct(*named).alias("_row")), model, lambda batch: batch.column(0).field(place)).filter("_likely")
    return kept.select("_row.*")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of `documents` with `lang_pred` and `score`, the posterior of the predicted language with equal priors.

    A word's probability in a language is the sum over its segmentations into pieces of a fixed public vocabulary of the
    products of the pieces' probabilities; a text's is the product over its words (whole runs of letters, in lower case). Only
    the text is read. A text that is null or has no letter is
    `und` with score 0, as is every text if nothing was learned. Ties go to the first language by name. Repeated rows
    each give a row, an empty table gives an empty result, columns named like the results are replaced.
    """
    documents = documents.drop("lang_pred", "score")
    place = _text_at(documents)
    return _told(documents, model, lambda batch: batch.column(place)).drop("_likely")
