"""Token files against the tokenizer's own output, text by text."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gaugeframe.llm import queries, re_pair
from gaugeframe.session import scratch_path
from tests.llm.conftest import edge_rows

MODEL = re_pair.public_model()


def plain_ids(text):
    return [*Tokenizer.from_str(MODEL).encode(text or "", add_special_tokens=False).ids, 2]


def plain_digests(rows):
    """Rows of (doc_id, start, n_tokens, crc); null doc_ids first, equal doc_ids in any order."""
    encoded = sorted(((d, plain_ids(t)) for d, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out, start = [], 0
    for d, ids in encoded:
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def without_ties(rows):
    """One row of each doc_id: the order among others is not fixed."""
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("shard", [50, 1000, re_pair.SHARD])
def test_files_hold_the_tokenizers_ids(spark, edges, nothing, shard):
    rows = without_ties(edge_rows())
    chosen = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    path = scratch_path(spark, "ids")
    re_pair.write_ids(chosen, path, MODEL, shard=shard)
    got = re_pair.document_digests(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_digests([r[:2] for r in rows]), key=str)
    wanted = spark.createDataFrame([(18,), (5,), (21,), (999,)], "doc_id long")
    held = {}
    for r in sorted(re_pair.read_ids(spark, path, wanted).collect(), key=lambda r: (r.part, r.doc, r.shard)):
        held.setdefault(r.doc_id, []).extend(r.ids)
    assert held == {d: plain_ids(t) for d, t, *_ in rows if d in (18, 5, 21)}
    empty = scratch_path(spark, "ids")
    re_pair.write_ids(nothing, empty, MODEL)
    assert re_pair.document_digests(spark, empty).count() == 0


def test_repeated_rows_and_clashing_names(spark, edges):
    path = scratch_path(spark, "ids")
    re_pair.write_ids(edges, path, MODEL)
    got = re_pair.document_digests(spark, path).collect()
    want = plain_digests([r[:2] for r in edge_rows()])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], *r[2:]) for r in want)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == list(np.cumsum([0] + [n for _, n in starts])[:-1])
    assert [r.doc_id is None for r in sorted(got, key=lambda r: r.start)][:3] == [True, True, False]


def test_words_encoded_apart_give_the_ids_of_the_text():
    r = random.Random(4)
    signs = list("aAbBzZ09 \t\n\r\x0b\x0c\x1c\x85\xa0.,!?'\"-_éÉßΣσςİıǅ́̈​ 日本語한글") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "ﬁ", "👍🏽", "  "]
    texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(3000)]
    ids, sizes = re_pair.WordIds(MODEL)(texts)
    want = [e.ids for e in Tokenizer.from_str(MODEL).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_letters_are_encoded_once_for_all_cases_and_signs():
    texts = ["Ära ära ÄRA, ära.!! ära|", "end end. End", "a'll <|endoftext|>. x2. ª. ªa", "Ära! end, ... ., ."]
    ids, seen = re_pair.WordIds(MODEL), []
    for name in ("encode", "encode_letters"):
        inner = getattr(ids, name)
        setattr(ids, name, lambda words, inner=inner, **a: (seen.extend(" ".join(words).lower().replace(ids.mark, " ").split()), inner(words, **a))[1])
    want = Tokenizer.from_str(MODEL).encode_batch(texts, add_special_tokens=False)
    for some in (texts[:2], texts):  # the second time with words that are known
        flat, sizes = ids(some)
        assert flat.tolist() == [i for e in want[: len(some)] for i in e.ids] and sizes.tolist() == [len(e) for e in want[: len(some)]]
    assert sum("ära" in w for w in seen) == 1 and sum("end" in w for w in seen if "text" not in w) == 1
    random.seed(7)
    plain = ["".join(random.choices("aZéÀÿßöÖbe", k=random.randint(1, 12))) + "".join(random.choices("!#$%&*+,./:;=?@^_`~|-", k=random.randint(0, 3))) for _ in range(5000)]
    assert ids([" ".join(plain)])[0].tolist() == Tokenizer.from_str(MODEL).encode(" ".join(plain), add_special_tokens=False).ids


def test_a_tokenizer_of_another_kind_encodes_whole_words():
    other = json.loads(MODEL)
    other["normalizer"]["normalizers"].pop()  # keeps case
    other = json.dumps(other)
    texts = ["Ab ab. AB, ab", "é É! x2 it's"]
    ids, sizes = re_pair.WordIds(other)(texts)
    want = [e.ids for e in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_grammar_gives_every_range_back():
    r = random.Random(5)
    for n in (0, 1, 2, 5, 300, 4000):
        for symbols in (1, 2, 30):
            sizes = []
            while sum(sizes) < n:
                sizes.append(min(r.randint(1, 200), n - sum(sizes)))
            ids = np.array([r.randrange(symbols) for _ in range(n)], np.int64)
            lefts, rights, lengths, rest = (v.astype(np.int64) for v in re_pair.compress(ids, np.array(sizes, np.int64), 30, 3))
            assert re_pair.decode(lefts, rights, lengths, rest, 30, 0, n).tolist() == ids.tolist()
            for _ in range(20):
                a, b = sorted((r.randint(0, n), r.randint(0, n)))
                assert re_pair.decode(lefts, rights, lengths, rest, 30, a, b).tolist() == ids[a:b].tolist()
            size = np.concatenate([np.ones(30, np.int64), lengths])
            assert set(np.cumsum(sizes)) <= set(np.cumsum(size[rest]))  # no symbol spans two documents
            if symbols == 1 and n >= 300:
                assert len(rest) < n / 2


def test_joined_crcs():
    data = random.Random(6).randbytes(3000)
    cuts = [0, 0, 1, 700, 2999, 3000, 3000]
    pieces = [(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
    assert re_pair.joined_crc(pieces) == zlib.crc32(data)


def test_registered_query(spark, tmp_path):
    rows = without_ties(edge_rows())
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_token_files"](spark, str(tmp_path))
    assert [f.simpleString() for f in got.schema.fields] == ["doc_id:bigint", "start:bigint", "n_tokens:bigint", "ids_crc32:bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_digests([r[:2] for r in rows]), key=str)
