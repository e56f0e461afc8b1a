"""Toxic texts by a linear classifier that is held to the same score when an identity term is swapped for another."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.language import LETTERS
from gaugeframe.llm.storage import stored

#: Neutral mentions of groups; within a line each can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("african", "european", "american", "mexican", "chinese"), ("old", "young"), ("disabled", "blind", "deaf"), ("immigrants", "natives"),
)
#: Different labelled texts that the weights are fitted on, at most (in expectation, by a hash of the text).
FIT_ROWS = 12_000
#: Letters of a word's beginnings that are features beside the word; `*` marks them.
BEGINNINGS = (4, 5, 6)
#: A feature is kept if so many texts hold it and its share differs between the labels by so many standard errors.
LEAST_TEXTS, LEAST_Z, MOST_FEATURES = 3, 4.0, 4000
RIDGE, PENALTY, STEPS = 1e-4, 1.0, 600
THRESHOLD = 0.7


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


def _swaps() -> dict[str, str]:
    return {a: b for line in IDENTITY_TERMS for a, b in zip(line, line[1:] + line[:1], strict=True)}


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label hold a feature."""
    for batch in batches:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for text, label, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = counts[label]
            for f in {f for w in set(LETTERS.findall((text or "").lower())) for f in features_of(w)}:
                own[f] = own.get(f, 0) + copies
        keys = list({**counts[0], **counts[1]})
        columns = [pa.array(keys, pa.string()), *[pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in counts]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])


class Lookup:
    """Places of a text's features in the model. Words are remembered with what they hold."""

    def __init__(self, features: list[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, words: set[str]) -> set[int]:
        if len(self.known) > 1_000_000:
            self.known.clear()
        found: set[int] = set()
        for w in words:
            hit = self.known.get(w)
            if hit is None:
                hit = self.known[w] = tuple(self.place[f] for f in features_of(w) if f in self.place)
            if hit:
                found.update(hit)
        return found


def _examples(features: list[str]):
    """A labelled text's features, and those of its counterfactual."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, swaps = Lookup(features), _swaps()
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = set(LETTERS.findall((text or "").lower()))
                own.append(sorted(lookup.of(words)))
                other.append(sorted(lookup.of({swaps.get(w, w) for w in words})) if not swaps.keys().isdisjoint(words) else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["label", "copies", "own", "other"])

    return f


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.array([i for r in rows for i in r], np.int64)


def _solve(n: int, labels: np.ndarray, copies: np.ndarray, own: list[list[int]], other: list[list[int] | None]) -> tuple[np.ndarray, float]:
    """Weights and intercept of least logistic loss (both labels count the same, a text as often as it occurs), with a ridge
    and the mean squared change of the logit under swaps."""
    row, col = _sparse(own)
    paired = [i for i, o in enumerate(other) if o is not None]
    first, second = _sparse([own[i] for i in paired]), _sparse([other[i] for i in paired])
    toxic, total, swapped = copies @ labels, copies.sum(), copies[paired]
    share = copies * np.where(labels > 0, 0.5 / max(1, toxic), 0.5 / max(1, total - toxic))
    w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        logit = np.bincount(row, weights=w[col], minlength=len(labels)) + b
        off = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * share
        grad = np.bincount(col, weights=off[row], minlength=n) + RIDGE * w
        if paired:
            change = np.bincount(first[0], weights=w[first[1]], minlength=len(paired)) - np.bincount(second[0], weights=w[second[1]], minlength=len(paired))
            change = 2 * PENALTY * change * swapped / swapped.sum()
            grad += np.bincount(first[1], weights=change[first[0]], minlength=n) - np.bincount(second[1], weights=change[second[0]], minlength=n)
        g = np.append(grad, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


Model = tuple[list[str], np.ndarray, float]


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, hashed: str | None = None) -> Model:
    """(features, weights, intercept) from rows (text, toxic).

    About `fit_rows` different texts, those with the least hashes, are read with all their copies; equal texts of one label are
    one example that counts as often as it occurs. What comes to the driver is at most MOST_FEATURES features and a
    short list of them for each example. Features are words and their first 4 to 6 letters that tell the labels apart, with
    all identity terms that occur. Swapped copies of texts with identity terms carry no label: the fit pays for the squared
    difference of their logits, so that a group's name moves no score.

    `hashed` names a column with xxhash64 of the text. Taken before texts meet their labels, it lets the choice be made there.
    """
    of_text = F.col(hashed) if hashed else F.xxhash64("text")
    rows = labelled.filter(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("text", (F.col("toxic") > 0).cast("int").alias("label"), of_text.alias("hash"))
    n = rows.select("hash").distinct().count()
    if not n:
        return [], np.zeros(0), -1.0
    below = int(min(1.0, fit_rows / n) * (1 << 50))
    chosen = rows.filter(F.pmod("hash", F.lit(1 << 50)) < below).groupBy("text", "label").agg(F.count(F.lit(1)).alias("copies"))
    chosen = stored(chosen, "toxicity-examples")
    counts = chosen.mapInArrow(_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = chosen.agg(F.coalesce(F.sum(F.col("label") * F.col("copies")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    toxic, clean = max(1, sizes[0]), max(1, sizes[1] - sizes[0])
    p, q = F.col("toxic") / toxic, F.col("clean") / clean
    both = (F.col("toxic") + F.col("clean")) / float(toxic + clean)
    z = F.abs(p - q) / F.sqrt(both * (1 - both + 1e-9) * (1 / toxic + 1 / clean))
    terms = [t for line in IDENTITY_TERMS for t in line]
    told = counts.filter(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    features = [r[0] for r in told.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).select("feature").collect()]
    named = {r[0] for r in counts.filter(F.col("feature").isin(terms)).select("feature").collect()}
    features += sorted(named - set(features))
    examples = chosen.mapInArrow(_examples(features), "label int, copies long, own array<int>, other array<int>").collect()
    labels, copies = (np.array([r[c] for r in examples], float) for c in ("label", "copies"))
    w, b = _solve(len(features), labels, copies, [r["own"] for r in examples], [r["other"] for r in examples])
    return features, w, float(b)


def _scores(sent, keep: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w, b = sent.value
        lookup = Lookup(features)
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = lookup.of(set(LETTERS.findall((text or "").lower())))
                logit = b + (float(w[sorted(found)].sum()) if found else 0.0)
                out.append(1 / (1 + np.exp(-min(40.0, max(-40.0, logit)))))
            columns = [batch.column(i) for i in range(keep)] + [pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "score", "predicted"])

    return f


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of `documents` with `score` (0 to 1) and `predicted` (1 from 0.7 on), from the text alone.

    A null text, or one without a known feature, has the intercept's score. Without labels to learn from all scores are
    1 / (1 + e). Repeated rows each give a row, an empty table an empty result; columns named like the results are replaced.
    """
    inner = documents.drop("score", "predicted")
    sent = documents.sparkSession.sparkContext.broadcast(model)  # MOST_FEATURES and the identity terms at most
    row = [F.col(f"`{c}`") for c in inner.columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields] + ["score double", "predicted int"])
    return inner.select(*row, F.col("text").alias("_text")).mapInArrow(_scores(sent, len(row)), schema)
