"""Repeated word sequences by suffix automata of reference shards and matching statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import native
from gaugeframe.llm.arrays import word_hashes
from gaugeframe.llm.repeats import Kind, remove_repeats
from gaugeframe.llm.suffix_groups import joined_spans

LENGTH = 50
#: Words of a reference shard, at most (but for one anchor's contexts, which stay together).
MOST = 1 << 16


class SuffixAutomaton:
    """All factors of the sequences put in, as paths from the first state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, symbol: int) -> int:
        """Split the state that `symbol` leads to from p, so that its longest path is one longer than p's."""
        nxt, link, length = self.next, self.link, self.length
        q, new = nxt[p][symbol], len(length)
        nxt.append(nxt[q].copy()), link.append(link[q]), length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = new
            p = link[p]
        link[q] = new
        return new

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for s in sequence:
            q = nxt[last].get(s)
            if q is not None:  # known from another sequence
                last = q if length[q] == length[last] + 1 else self._copy(last, s)
                continue
            new, p = len(length), last
            nxt.append({}), link.append(0), length.append(length[last] + 1)
            while p >= 0 and s not in nxt[p]:
                nxt[p][s] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][s]
                link[new] = q if length[q] == length[p] + 1 else self._copy(p, s)
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each end, the length of the longest factor that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for s in sequence:
            while state and s not in nxt[state]:
                state = link[state]
                size = length[state]
            if s in nxt[state]:
                state = nxt[state][s]
                size += 1
            out.append(size)
        return out


def matched(contexts: list[np.ndarray], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the spans of at least `length` words that factors of contexts with lesser ids cover.

    Contexts come in ascending order of ids: those of a document stream through the automaton of all lesser ones, then join it.
    """
    automaton, which, start = SuffixAutomaton(), [], []
    words = [c.tolist() for c in contexts]
    at = 0
    while at < len(words):
        to = at
        while to < len(words) and ids[to] == ids[at]:
            if at:
                ends = [e for e, size in enumerate(automaton.statistics(words[to])) if size >= length]
                which += [to] * len(ends)
                start += [e + 1 - length for e in ends]
            to += 1
        if to < len(words):
            for w in words[at:to]:
                automaton.add(w)
        at = to
    return joined_spans(np.array(which, np.int64), np.array(start, np.int64), length)


#: Anchors of 8 words: any 50 words hold 43 of them.
KIND = Kind(symbols=word_hashes, codes=lambda data: word_hashes(data).astype("<u8"), length=LENGTH, k=8)


def _kept(data: np.ndarray, kept: np.ndarray) -> bytes:
    return b" ".join(w for w, k in zip(data.tobytes().split(), kept.tolist(), strict=True) if k)


def remove_repeated_words(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every row of (doc_id, text).

    A word goes if a window of 50 words that covers it also starts in a document with a lesser doc_id, judged on the
    input. Reference shards are the contexts of anchors, dealt out by anchor with the documents that may match them, so
    an automaton is sent to the tasks that need it and never to all: a broadcast would grow with the corpus.

    Null texts count as empty. Null doc_ids are the greatest and equal among themselves; rows with equal doc_ids never
    remove from each other. Texts under 50 words stay whole. Repeated rows each give a row, an empty table gives an empty
    result, other columns are not used. Words are compared by 64-bit hashes.
    """
    text = F.col("text")
    one_space = F.regexp_replace(F.btrim(text, F.lit(native.BLANKS)), native.SPACE, " ").cast("binary")
    found = remove_repeats(documents, KIND, matched, "<u8", MOST, _kept, native.n_words(text), one_space)
    return found.withColumnRenamed("size", "n_words")
