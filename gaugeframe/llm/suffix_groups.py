"""Repeated byte strings by suffix arrays that are built from groups, in linear time and without recursion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrays import SYMBOLS
from gaugeframe.llm.repeats import Kind, remove_repeats

LENGTH = 50
#: Bytes of contexts that one suffix array takes in, at most (but for one anchor's contexts, which stay together).
MOST = 1 << 18


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order.

    Phase 1 sorts suffixes into groups by their Lyndon prefix. Groups begin as the first symbols and are taken from the
    highest down. Each member's previous-smaller pointer is the nearest place before it in a lower group (places in
    higher groups are done and pass on their own pointer). A place that k members point to reads on with k copies of
    the group's prefix, so it moves to a new group just above its own, the higher the larger k.

    Phase 2 emits the order. The suffixes whose next smaller suffix is the one emitted last are a chain of pointers
    that starts right before it; each takes the first free place of its group.
    """
    n = len(text)
    members: list[list[int]] = []
    symbols = sorted(set(text))
    group_of = {s: g for g, s in enumerate(symbols)}
    group = [group_of[s] for s in text]
    members = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = [g - 1 for g in range(len(symbols))], [g + 1 for g in range(len(symbols))]
    top = len(symbols) - 1  # the group above it is `end`
    end = -2
    if symbols:
        above[top] = end
    done, before, descending = bytearray(n), [-1] * n, []
    current = top
    while current >= 0:
        held = [i for i in members[current] if group[i] == current]
        held.sort()
        members[current] = held
        pointed: dict[int, int] = {}
        for i in held:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            done[i] = 1  # a later member that meets this one goes on to the same place
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            by = moved.get(group[p])
            if by is None:
                by = moved[group[p]] = {}
            if k in by:
                by[k].append(p)
            else:
                by[k] = [p]
        for g, by in moved.items():
            low = g
            for k in sorted(by) if len(by) > 1 else by:
                new, high = len(members), above[low]
                members.append(by[k])
                for p in by[k]:
                    group[p] = new
                below.append(low), above.append(high)
                above[low] = new
                if high >= 0:
                    below[high] = new
                low = new
        descending.append(current)
        current = below[current]
    start, place = [0] * len(members), 0
    for g in reversed(descending):
        start[g] = place
        place += len(members[g])
    order, put = [0] * n, bytearray(n)

    def emit(j: int) -> None:
        while j >= 0 and not put[j]:
            put[j] = 1
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            j = before[j]

    emit(n - 1)
    for i in range(n):
        j = order[i] - 1
        if j >= 0 and not put[j]:
            emit(j)
    return order


def repeated(contexts: list[np.ndarray], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the strings of `length` bytes that also start in a context of a lesser id, overlaps joined."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.zeros(sizes.sum() + length, np.int16)  # 0 after each context
    first = np.cumsum(sizes) - sizes
    for f, c in zip(first, contexts, strict=True):
        text[f : f + len(c)] = c.astype(np.int16) + 1
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(owner)) - first[owner]
    order = np.array(suffix_array(text[: len(owner)].tolist()), np.int64)
    order = order[offset[order] + length < sizes[owner[order]]]  # suffixes that hold a whole string
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 16):
        some = order[at - 1 : at + (1 << 16)]
        same[at : at + len(some) - 1] = (windows[some[1:]] == windows[some[:-1]]).all(axis=1)
    head = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(ids[owner[order]], head), np.diff(np.append(head, len(order)))) if len(order) else order
    hit = np.sort(order[ids[owner[order]] > least])
    return joined_spans(owner[hit], offset[hit], length)


def joined_spans(which: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of `length` that begin at sorted (which, start), with those that touch or overlap as one."""
    if not len(which):
        return which, start, start
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] > start[:-1] + length)
    head = np.flatnonzero(new)
    return which[head], start[head], start[np.append(head[1:], len(which)) - 1] + length


#: Anchors of 25 bytes: any 50 bytes hold 26 of them, and few are equal by chance.
KIND = Kind(symbols=lambda data: SYMBOLS[data], codes=lambda data: data, length=LENGTH, k=25)


def remove_repeated_bytes(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of (doc_id, text).

    A byte goes if a string of 50 bytes that covers it also starts in a document with a lesser doc_id, judged on the
    input. Contexts that may hold such strings are dealt out by anchor; each task sorts their suffixes by groups, and
    equal first 50 bytes stand next to each other.

    Null texts count as empty. Null doc_ids are the greatest and equal among themselves; rows with equal doc_ids never
    remove from each other. Texts under 50 bytes stay whole. Repeated rows each give a row, an empty table gives an empty
    result, other columns are not used. Contexts are told apart by hashes of over 80 bits with their anchor.
    """
    data: Column = F.col("text").cast("binary")
    found = remove_repeats(
        documents, KIND, repeated, "u1", MOST, lambda text, kept: text[kept].tobytes(), F.octet_length(data).cast("long"), data
    )
    return found.withColumnRenamed("size", "n_bytes")
