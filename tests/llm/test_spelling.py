"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugeframe.llm import queries, spelling
from tests.llm.conftest import edge_rows

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return rows


def documents():
    r = random.Random(11)
    base = ["".join(r.choices("abcdeéß", k=r.randint(6, 9))) for _ in range(40)] + ["aaaaaa", "a" * 300, "abab" * 40]
    words = []
    for w in base:
        words += [w] * r.choice([5, 30, 200, 1200])
        for _ in range(6):
            i = r.randrange(len(w))
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("xyzé") + w[i:], w[:i] + r.choice("xyz") + w[i + 1 :], w.upper()])] * r.choice([1, 4, 5, 6, 40])
    words += ["qqqqqaa"] * 6 + ["qqqqqab"] * 40 + ["qqqqqbb"] * 400  # a chain of forms
    r.shuffle(words)
    texts = [r.choice([" ", ", ", "\n", "1", "_", "Ÿ"]).join(words[i : i + 50]) for i in range(0, len(words), 50)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(r[0], r[1]) for r in edge_rows()] + [(None, "aaaaaa ×÷×÷×÷ ") for _ in range(7)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in documents()], "doc_id long, text string, word string, n int").repartition(3)


def test_query_against_all_pairs(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert [f.simpleString() for f in got.schema.fields] == ["word:string", "form:string", "root:string", "n:bigint", "n_near:bigint", "form_n:bigint"]
    rows = got.collect()
    assert len(rows) == len({r.word for r in rows})
    want = plain_variants(plain_counts(documents()))
    assert {tuple(r) for r in rows} == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_no_documents(spark, frame, tmp_path):
    frame.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)).count() == 0


def test_a_crowded_reduced_word(spark):
    """More words of one reduced word than a block holds."""
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz" if spelling._reduced(spelling._letters(c))[0] == spelling._reduced(spelling._letters("e"))[0]]
    letters += [chr(c) for c in range(0xE0, 0x100) if spelling._reduced(np.array([c]))[0] == spelling._reduced(spelling._letters("e"))[0]]
    r = random.Random(3)
    counts = {"".join(r.choices(letters, k=6)): r.randint(5, 400) for _ in range(900)}
    assert len(counts) > 2 * spelling.BLOCK
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == plain_variants(counts)


def test_neighbourhoods_hold_all_edits_of_reduced_words():
    r = random.Random(2)
    for _ in range(200):
        word = "".join(r.choices("abcdefghij", k=r.randint(1, 12)))
        i, c = r.randrange(len(word)), r.choice("abcdefghij")
        names = set(spelling.neighbourhood(word).tolist())
        for other in (word, word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word + c):
            if other:
                assert int(spelling.reduced_key([other])[0]) in names


def test_a_batch_without_any_near_pair():
    words = lambda *held: pa.array([list(h) for h in held], pa.list_(pa.string()))
    counts = pa.array([[5], [6, 7]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([words(["abcdef"], ["uvwxyz"]), words(["ghijkl"], ["mnopqr", "mnopqs"]), counts], names=["a", "b", "b_n"])
    assert sum(b.num_rows for b in spelling._compared([batch, batch.slice(0, 0)])) == 0
    near_ones = pa.RecordBatch.from_arrays([words(["abcdef"], ["uvwxyz"]), words(["abcdeg"], ["uvwxyz", "uvwxy"]), counts], names=["a", "b", "b_n"])
    assert [tuple(r.values()) for b in spelling._compared([near_ones.slice(1, 1)]) for r in b.to_pylist()] == [("uvwxyz", "uvwxy", 7)]
