"""Every operator against a plain version of it, on rows with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeframe.llm import arrays, automata, context_trees, decontamination, fingerprints, jaccard, language, mixing, native, queries, sharding, suffix_groups, toxicity
from tests.llm.conftest import edge_rows, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = edge_rows()
sha = lambda b: hashlib.sha256(b).hexdigest()


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [shingles(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if r[0] is None else r[0])
    return sets, [least[find(i)] for i in range(len(rows))]


def test_jaccard_join_finds_all_components(edges, nothing):
    sets, least = plain_components(ROWS)
    expected = Counter((r[0], len(s), None if m == math.inf else m) for r, s, m in zip(ROWS, sets, least, strict=True))
    assert Counter(tuple(r) for r in jaccard.similar_groups(edges).collect()) == expected
    assert jaccard.similar_groups(nothing).count() == 0


def test_jaccard_join_at_the_threshold(spark):
    # 80 words have 76 shingles: with 57 of them the similarity is 0.75, with 56 it is below
    w, v = [f"w{i}" for i in range(80)], [f"v{i}" for i in range(80)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:61])), (3, " ".join(w[:60] + ["x"])), (4, " ".join(v)), (5, " ".join(v[:60]))]
    out = {r[0]: r[2] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}  # 3 links with 2 only


def shuffled_bytes(spark):
    """What all stages so far have written for shuffles."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_jaccard_join_sends_no_more_into_many_parts(spark):
    # a text's tokens fall into nearly as many parts as there are tokens; its name and size for each part cost 3 times the tokens
    r = random.Random(5)
    text = lambda: " ".join(f"{r.getrandbits(40):x}" for _ in range(150))
    texts = spark.createDataFrame(spark.sparkContext.parallelize([(i, text()) for i in range(600)], 2), "node long, text string")
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        sets = jaccard.shingle_sets(texts, 5, 75).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(s.node for s in sets) == list(range(600)) and {(s["size"], s.tokens) for s in sets} == {(146, None)}
    sent = sum(b for stage, b in shuffled_bytes(spark).items() if stage not in before)
    assert sent < 6 * 600 * 146


def test_jaccard_join_of_chains_and_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WORDS", 1)  # 64 bits for all nodes: sets without partners have the bits of others
    r = random.Random(6)

    def changed(text, n):
        text = list(text)
        for i in r.sample(range(len(text)), n):
            text[i] = f"{r.getrandbits(40):x}"
        return text

    texts = []
    for f in range(4):
        base = words(300 + f, 100)
        for _ in range(12):
            base = changed(base, 2)  # links with its neighbours in the chain at most
            texts.append(base)
        for _ in range(8):
            other = changed(base, 5)  # shares buckets with the others, but links with its own copies only
            texts += [other, changed(other, 1), changed(other, 1)]
    texts += [words(400 + i, 100) for i in range(30)]
    r.shuffle(texts)
    rows = [(i, " ".join(t), None, None) for i, t in enumerate(texts)]
    sets, least = plain_components(rows)
    assert 50 < len(set(least)) < len(rows)
    got = jaccard.similar_groups(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(x) for x in got) == [(i, len(s), m) for i, (s, m) in enumerate(zip(sets, least, strict=True))]


def test_one_of_each_keeps_one_document_of_a_group(edges):
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns
    _, least = plain_components(ROWS)
    expected = {r[0] for r, m in zip(ROWS, least, strict=True) if not shingles(r[1]) or r[0] == m} | {None}
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert set(ids) == expected and len(ids) == len(expected)


def test_a_finished_task_keeps_no_freed_memory():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    pins = []

    def work(batches):
        for batch in batches:
            held = [b"x" * 60_000 for _ in range(4000)]
            pins.append(b"x" * 60_000)  # above what is freed, so that it stays in the process
            yield len(held)

    for run in (lambda: list(arrays.batchwise(work)([1])), lambda: arrays.groupwise(lambda table: list(work([table])))(1)):
        before = resident()
        run()
        assert resident() < before + 120  # of 240 MB


def plain_removal(rows, seq, join):
    """Windows of 50 seen in lesser documents; null ids are the greatest."""
    order = sorted(range(len(rows)), key=lambda i: math.inf if rows[i][0] is None else rows[i][0])
    first, out = {}, {}
    for i in order:
        s = seq(rows[i][1] or "")
        key = math.inf if rows[i][0] is None else rows[i][0]
        gone = bytearray(len(s))
        for j in range(len(s) - 49):
            if first.setdefault(tuple(s[j : j + 50]), key) < key:
                gone[j : j + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(s)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (rows[i][0], len(s), sum(gone), spans, sha(join([c for c, x in zip(s, gone, strict=True) if not x])))
    return Counter(out.values())


def test_repeated_bytes(edges, nothing):
    out = suffix_groups.remove_repeated_bytes(edges)
    assert Counter(tuple(r) for r in out.collect()) == plain_removal(ROWS, lambda t: t.encode(), bytes)
    assert suffix_groups.remove_repeated_bytes(nothing).count() == 0


def test_thousands_of_occurrences_of_one_anchor(spark):
    """A line that one document repeats in 12,000 different surroundings: each occurrence has its own context."""
    r = random.Random(17)
    line = "".join(r.choice("abcdefghij ") for _ in range(87))
    rows = [(d, "".join(line + "".join(r.choices("klmnopqrstuvwxyz", k=30)) for _ in range(12_000))) for d in (1, 2)]
    out = suffix_groups.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    first = rows[0][1]
    known = {first[i : i + 50] for i in range(len(first) - 49)}
    text = rows[1][1]
    edge = np.zeros(len(text) + 1, np.int64)
    for i in range(len(text) - 49):
        if text[i : i + 50] in known:
            edge[i] += 1
            edge[i + 50] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    got = {x.doc_id: x for x in out.collect()}
    assert got[1].n_removed == 0
    assert got[2].n_removed == len(text) - kept.sum()
    assert got[2].kept_sha256 == hashlib.sha256(np.frombuffer(text.encode(), np.uint8)[kept].tobytes()).hexdigest()


def test_repeated_words(edges, nothing):
    out = automata.remove_repeated_words(edges)
    assert Counter(tuple(r) for r in out.collect()) == plain_removal(ROWS, lambda t: t.encode().split(), b" ".join)
    assert automata.remove_repeated_words(nothing).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 3, 6])
def test_suffix_array_orders_all_suffixes(symbols):
    r = random.Random(symbols)
    for n in [0, 1, 2, 3, *range(5, 60)]:
        s = [r.randrange(symbols) for _ in range(n)]
        assert suffix_groups.suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def test_automaton_gives_matching_statistics():
    r = random.Random(3)
    for _ in range(100):
        texts = [[r.randrange(3) for _ in range(r.randrange(12))] for _ in range(4)]
        a = automata.SuffixAutomaton()
        for t in texts[:-1]:
            a.add(t)
        factors = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        expected = [max([n for n in range(1, e + 1) if tuple(texts[-1][e - n : e]) in factors], default=0) for e in range(1, len(texts[-1]) + 1)]
        assert a.statistics(texts[-1]) == expected


def with_weights(df):
    return df.withColumn("_q", F.when(F.col("doc_id") % 3 == 0, 2.0).when(F.col("doc_id") % 3 == 1, 0.5))


def test_mixture_meets_its_targets(edges, nothing):
    out = mixing.mix(with_weights(edges), native.n_words(F.col("text")), F.col("_q"), ["doc_id"]).collect()
    assert len(out) == len(ROWS)
    size = {(r[0], r[1]): len(WORD.findall(r[1] or "")) for r in ROWS}
    assert all(r["size"] == size[r["doc_id"], r["text"]] and 0 <= r["taken"] <= 2 * r["size"] for r in out)
    sources = sorted({r["source"] for r in out}, key=lambda s: (s is None, s))
    sums = {s: sum(r["size"] for r in out if r["source"] == s) for s in sources}
    weight = dict(zip(sources, itertools.cycle((5, 2, 1))))
    open_, left, target = set(sources), 1.5 * sum(sums.values()), {}
    while open_:  # water filling: share, stop what is above its bound, share the rest
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sums[s]}
        for s in above or open_:
            target[s] = min(share[s], 2.0 * sums[s])
        left -= sum(target[s] for s in above)
        open_ = open_ - above if above else set()
    for s in sources:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sums[s]}
        assert all(math.isclose(r["target"], target[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
        full = math.floor(target[s] / sums[s])
        assert all(full * r["size"] <= r["taken"] <= (full + 1) * r["size"] for r in mine)
    again = mixing.mix(with_weights(edges.repartition(5)), native.n_words(F.col("text")), F.col("_q"), ["doc_id"]).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in out)
    assert mixing.mix(with_weights(nothing), native.n_words(F.col("text")), F.col("_q"), ["doc_id"]).count() == 0


def test_better_documents_come_first_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("q"))
    taken = mixing.mix(rows, F.col("n"), F.col("q"), ["doc_id"], share=0.1).filter("taken > 0").groupBy("q").count().collect()
    share = {r["q"]: r["count"] for r in taken}
    assert 3.0 < share[4.0] / share[1.0] < 5.0


def test_sharding_is_a_permutation(spark, edges, nothing):
    size = F.octet_length(native.utf8(F.col("text"))) + 8
    out = sharding.two_pass_shuffle(edges, ["doc_id", "text"], 5, size).collect()
    assert Counter((r["doc_id"], r["text"], r["node"]) for r in out) == Counter((r[0], r[1], "x") for r in ROWS)
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.two_pass_shuffle(edges.repartition(4), ["doc_id", "text"], 5, size).collect()
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in again if r["doc_id"] != 19} == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in out if r["doc_id"] != 19}
    assert sharding.two_pass_shuffle(nothing, ["doc_id", "text"], 5, size).count() == 0
    ids = spark.range(2000).withColumn("n", F.lit(100))
    order = [r["id"] for r in sharding.two_pass_shuffle(ids, ["id"], 4, F.col("n"), bucket_bytes=4000).orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(2000)) and abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1


def test_shards_are_written_and_read_back(spark, edges, tmp_path):
    out = sharding.two_pass_shuffle(edges, ["doc_id", "text"], 3, F.lit(10))
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r[0], r[1]) for r in ROWS)


def plain_matches(rows, items):
    out = {}
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    for (d, t), (i, x) in itertools.product({(r[0], r[1]) for r in rows}, items):
        w, v = WORD.findall((t or "").lower()), WORD.findall((x or "").lower())
        if not v:
            continue
        k, best, b = min(5, len(v)), 0, None
        b = Counter(grams(v, k))
        for s in range(max(1, len(w) - len(v) + 1)):
            a = Counter(grams(w[s : s + len(v)], k))
            both = sum((a & b).values())
            best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
        if best >= 0.75:
            out[d, t, i] = best
    return Counter((d, i, round(s, 9)) for (d, _, i), s in out.items())


def test_benchmark_items_are_found(spark, edges, nothing):
    passage = words(1, 70)
    items = [(1, " ".join(passage[10:40])), (2, " ".join(passage[20:34] + ["other"] + passage[35:60])), (3, None), (4, " "), (5, "one two"), (6, "ONE"),
             (7, " ".join(words(900, 30))), (8, "same same same same same same"), (1, " ".join(passage[10:40]))]
    table = spark.createDataFrame([i + ("y",) for i in items], "item_id long, text string, node string")
    out = decontamination.matches(edges, table).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in out) == plain_matches(ROWS, items)
    kept = decontamination.decontaminate(edges, table)
    hit = {(r["doc_id"], r["node"]) for r in out}
    assert kept.columns == edges.columns and kept.count() == sum((r[0], None) not in {(h[0], None) for h in hit} or r[0] is None for r in ROWS)
    assert decontamination.matches(nothing, table).count() == 0 and decontamination.matches(edges, table.limit(0)).count() == 0


def test_items_in_another_order_are_found(spark):
    item = words(70, 40)
    rows = [(1, " ".join(words(71, 30) + item[20:] + item[:20] + words(72, 30))), (2, " ".join(item[20:] + item[:20])), (3, " ".join(words(73, 9) + item[10:20])),
            (4, " ".join("babababab" "ab")), (5, " ".join(item[2:])), (6, " ".join(words(74, 5) + item[:37] + item[:37]))]
    items = [(1, " ".join(item)), (2, " ".join("abababababa"))]
    out = decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in out)
    assert found == plain_matches(rows, items) and {(1, 1), (2, 1), (4, 2)} <= {k[:2] for k in found}
    assert {r["doc_id"]: r["start_word"] for r in out}[1] == 30


def test_only_candidates_are_shuffled_with_their_texts(spark, edges, monkeypatch):
    written = {}
    monkeypatch.setattr(decontamination, "stored", lambda df, label, put=decontamination.stored: (written.setdefault(label, df), put(df, label))[1])
    item = spark.createDataFrame([(1, " ".join(words(1, 70)[10:40]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.matches(edges, item).collect()} == {11, 12, 13}
    plan = written["windows"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    # a text's starts are rows, not places of a function over its array
    assert "posexplode(words" in written["candidates"]._jdf.queryExecution().optimizedPlan().toString()


def test_lower_words_are_cut_at_white_space_only(spark):
    texts = ["", " ", "\t\n\x0b\x0c\r ", "A  b", "\x0bx\ry\n", "ä\u00a0b\u2003c \x1cd\x85", "one\ttwo\n\nThree ", "ÉÈ ß", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", decontamination.lower_words(F.col("text")), native.words(F.lower("text")), native.n_words(F.col("text")))
    for i, low, plain, n in rows.collect():
        assert low == plain == WORD.findall((texts[i] or "").lower()) and n == len(low)


def test_hamming_blocks_meet_within_the_radius(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), decontamination.RADIUS):
            b ^= 1 << i
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(decontamination.blocks(F.col("a")).alias("a"), decontamination.blocks(F.col("b")).alias("b"))
    assert df.filter("exists(zip_with(a, b, (x, y) -> x = y), z -> z)").count() == 200


def jaccard_of(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def test_fingerprints_collide_like_generalised_jaccard(edges, nothing):
    out = fingerprints.with_edited(edges, native.words, 3).collect()
    key = lambda r: (math.inf if r[0] is None else r[0])
    rows = sorted(ROWS, key=key)
    assert len(out) == len(rows)
    by = {}
    for i, r in enumerate(rows):
        t, nxt = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        by[r[0]] = (len(t), sha(edited.encode()), jaccard_of(t, edited), jaccard_of(t, nxt))
    prints = {}
    for r in out:
        if r["doc_id"] is not None:  # two null ids are in the order of a hash
            n, digest, edited, following = by[r["doc_id"]]
            if r["doc_id"] not in (19, 111):
                assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
                assert abs(r["near_edited"] - edited) < 0.45 and abs(r["near_next"] - following) < 0.45
            prints.setdefault(next(x[1] for x in ROWS if x[0] == r["doc_id"]) or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.with_edited(nothing, native.words, 3).count() == 0


def test_collision_rate_is_unbiased(spark):
    a, b = {f"t{i}": 1 + i % 7 for i in range(60)}, {f"t{i}": 1 + (i * 3) % 5 for i in range(20, 80)}
    truth = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
    rows = [(k, s, f"{t}-{s}") for k, d in enumerate((a, b)) for s in range(60) for t, n in d.items() for _ in range(n)]  # 60 renamings of the terms
    terms = spark.createDataFrame(rows, "k int, s int, w string").withColumn("term", F.xxhash64("w"))
    marks = fingerprints.signatures(terms, ["k", "s"])
    pairs = marks.filter("k = 0").select("s", F.col("marks").alias("x")).join(marks.filter("k = 1").select("s", F.col("marks").alias("y")), "s")
    rate = pairs.agg(F.avg(fingerprints.likeness(F.col("x"), F.col("y")))).first()[0]
    assert abs(rate - truth) < 4 * math.sqrt(truth * (1 - truth) / (60 * 32))


def test_language_of_held_out_documents(spark, sf_dir, nothing):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(documents.filter("doc_id % 4 != 2"), F.lit(True), fit_rows=100)
    told = language.identify(documents.filter("doc_id % 4 = 2").withColumn("score", F.lit("x")), model)
    right, n = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    assert language.identify(nothing, model).count() == 0


def test_language_of_odd_texts(edges, nothing):
    model = language.fit(edges, F.lit(True))
    out = language.identify(edges, model).collect()
    assert len(out) == len(ROWS)
    for r in out:
        letters = bool(re.search(r"[^\W\d_]", r["text"] or ""))
        assert (r["lang_pred"] in ("de", "en", "fr")) == letters and (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.identify(edges, language.fit(nothing, F.lit(True))).collect()} == {"und"}


def test_language_stage_drops_foreign_texts_only(spark):
    clean = [(i, " ".join(words(500 + i, 60)), "en") for i in range(60)] + [(60, "ung", "en"), (61, "ok", None), (62, "thonre Ж", None)]
    foreign = [(70, "Это русский текст о погоде и людях, и он не короткий", None), (71, "日本語の文章です。今日は天気がいい", "en"), (72, "xkqzj vwpqx zzkxj qjxkv wqxzk jjqkx vxzqw", "en")]
    empty = [(80, "!!! 123", "en"), (81, None, "en"), (82, "", None)]
    kept = lambda rows: sorted(r[0] for r in corpus_pipeline.known_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    # foreign rows are held out or without a language, so that they are not learned
    apart = [(r[0], r[1], r[2] if held(r[0]) else None) for r in foreign]
    assert kept(clean + apart + empty) == [r[0] for r in clean]
    unknown = [(d, t, None) for d, t, _ in clean + foreign + empty]
    assert kept(unknown) == [r[0] for r in clean + foreign]
    out = [(d, t, "en") for d, t, _ in clean if held(d)]
    assert out and kept(out) == [r[0] for r in out]


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "c"]
    lattice = language.Pieces(pieces)
    p = np.array([0.2, 0.3, 0.1, 0.15, 0.05, 0.2, 0.0])[:, None]
    prob = dict(zip(pieces, p[:, 0]))

    def total(w):
        return 1.0 if not w else sum((prob.get(w[:n], 0.2 if n == 1 else 0)) * total(w[n:]) for n in range(1, min(8, len(w)) + 1))

    for w in ("a", "ab", "abab", "bac", "xab", "abcabcabcab"):
        assert math.isclose(lattice.word_logs([w], p)[0, 0], math.log(total(w)), rel_tol=1e-9)


def plain_logs(word, prob, unknown):
    """Log of the sum over all segmentations, letter by letter."""
    logs = [0.0]
    for i in range(1, len(word) + 1):
        terms = [logs[i - n] + math.log(q) for n in range(1, min(20, i) + 1) if (q := prob.get(word[i - n : i], unknown if n == 1 else 0))]
        logs.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
    return logs[-1]


def test_long_runs_of_letters_are_not_cut(monkeypatch):
    pieces = ["a", "ab", "b", "ba", "c", "abcabcabcabc"]
    lattice, r = language.Pieces(pieces), random.Random(3)
    p = np.array([[0.2, 0.1], [0.25, 0.1], [0.1, 0.2], [0.15, 0.2], [0.05, 0.1], [0.05, 0.1], [0.2, 0.2], [0.0, 0.0]])
    some = ["".join(r.choice("abcx") for _ in range(n)) for n in (1, 30, 32, 33, 64, 500, 2049, 3000)] + ["abc" * 400]
    for block in (language.BLOCK, 32, 50):
        monkeypatch.setattr(language, "BLOCK", block)
        got = lattice.word_logs(some, p)
        for w, row in zip(some, got, strict=True):
            for g in (0, 1):
                assert math.isclose(row[g], plain_logs(w, dict(zip(pieces, p[:, g])), 0.2), rel_tol=1e-9)


def test_fit_of_long_runs_is_that_of_short_ones(monkeypatch):
    r = random.Random(5)
    some = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(60)]
    counts, lattice = np.array([r.randint(1, 9) for _ in some], float), language.Pieces(["a", "ab", "b", "ba", "c", "cabca"])
    usual = lattice.fit(some, counts)
    monkeypatch.setattr(language, "SHORT", 0)
    monkeypatch.setattr(language.Pieces, "groups", lambda self, words: iter(()))
    for block in (language.BLOCK, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        assert np.allclose(lattice.fit(some, counts), usual, rtol=1e-9)


def test_language_is_fitted_by_tasks(edges, monkeypatch):
    """No word comes to the driver, and however rows are dealt, the probabilities are those of all words at once."""
    counts = {}
    for r in edges.collect():
        for w in language.runs_of_letters(r["text"]) if r["lang"] else []:
            own = counts.setdefault(r["lang"], {})
            own[w] = own.get(w, 0) + 1
    lattice = language.Pieces(language.vocabulary())
    whole = [lattice.fit(list(counts[k]), np.array(list(counts[k].values()), float)) for k in sorted(counts)]
    logs = [np.array(list(c.values())) @ lattice.word_logs(list(c), p[:, None])[:, 0] / sum(len(w) * n for w, n in c.items()) for c, p in zip((counts[k] for k in sorted(counts)), whole)]
    seen = set()
    for name in ("collect", "toPandas", "toArrow"):
        take = getattr(type(edges), name)
        monkeypatch.setattr(type(edges), name, lambda self, *a, take=take, **k: (seen.update(self.columns), take(self, *a, **k))[1])
    monkeypatch.setattr(language.Pieces, "lattice", None)  # of the driver; workers import their own
    models = [language.fit(rows, F.lit(True)) for rows in (edges, edges.repartition(7))]
    for langs, _, p, usual in models:
        assert langs == sorted(counts) and np.allclose(p, np.stack(whole, axis=1), rtol=1e-9) and np.allclose(usual, logs, rtol=1e-9)
        assert np.array_equal(p, models[0][2]) and np.array_equal(usual, models[0][3])
    assert "lang" in seen and not seen & {"word", "text"}


def test_language_sends_a_text_once(edges):
    model = language.fit(edges, F.lit(True))
    for told in (language.likely(edges, model), language.identify(edges, model)):
        node = told._jdf.queryExecution().analyzed()
        while node.nodeName() != "MapInArrow":
            node = node.children().head()
        assert re.findall(r"\b_?text\b", node.children().head().schema().simpleString()) == ["text"]


def test_words_are_looked_up_once_and_forgotten_without_a_trace(edges, monkeypatch):
    place = language._places()
    assert [place[w] for w in ("b", "a", "b", "c")] == [0, 1, 0, 2] and list(place) == ["b", "a", "c"]
    langs, pieces, p, usual = language.fit(edges, F.lit(True))
    texts = arrays.pa.array([r[1] for r in ROWS] * 30, arrays.pa.string())
    batch = arrays.pa.record_batch([texts], names=["text"])
    told = []
    for most in (language.REMEMBERED, 0):
        monkeypatch.setattr(language, "REMEMBERED", most)
        sent = type("Sent", (), {"value": (langs, pieces, p, usual)})
        told += list(language._predict(sent, lambda b: b.column(0))([batch]))
    assert told[0].equals(told[1]) and told[0].num_rows == len(texts)


def test_a_language_of_copies_is_learned(spark):
    """Two languages of few texts with many copies each, beside one of many texts: none is left without words."""
    rows = [(" ".join(words(900 + i % 3, 30)), "en") for i in range(900)]
    rows += [(" ".join(["zwar", "doch", "nicht", "immer"][i % 4] for _ in range(20)), "de") for i in range(900)]
    rows += [(f"mot{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} toujours", "fr") for i in range(600)]
    langs, _, p, usual = language.fit(spark.createDataFrame(rows, "text string, lang string"), F.lit(True), fit_rows=5)
    assert langs == ["de", "en", "fr"] and np.isfinite(usual).all()


def test_registered_language_query(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = documents.collect()
    out = {r["doc_id"]: r for r in queries.QUERIES["op5_language_id"](spark, sf_dir).collect()}
    assert len(out) == len(kept) and set(out[kept[0]["doc_id"]].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    for r in kept:
        o, letters = out[r["doc_id"]], bool(re.search(r"[^\W\d_]", r["text"] or ""))
        assert o["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and (o["lang_pred"] == "und") == (not letters) and 0 <= o["score"] <= 1
    told = [(r["lang"], out[r["doc_id"]]["lang_pred"]) for r in kept if out[r["doc_id"]]["held_out"] and r["lang"]]
    assert sum(a == b for a, b in told) >= 0.97 * len(told)


def labelled_rows():
    r = random.Random(4)
    plain, bad = [f"plain{i}" for i in range(200)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        w = [r.choice(plain) for _ in range(20)] + ([r.choice(bad)] if toxic else [])
        # one group is named in toxic rows mostly, the other in clean ones
        if r.random() < (0.6 if toxic else 0.1):
            w.append("muslim")
        if r.random() < (0.1 if toxic else 0.6):
            w.append("christian")
        r.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_is_told_and_group_names_are_not(spark, edges, nothing):
    rows = labelled_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id % 4 != 0"))
    out = toxicity.score(df.filter("doc_id % 4 = 0").withColumn("score", F.lit("x")), model).collect()
    assert all(r["predicted"] == r["toxic"] for r in out)
    probe = spark.createDataFrame([("plain1 muslim plain2",), ("plain1 christian plain2",), ("plain1 scum",), ("",), (None,)], "text string")
    a, b, c, d, e = (r["score"] for r in toxicity.score(probe, model).collect())
    assert abs(a - b) < 0.05 and c >= 0.7 and max(a, b, d, e) < 0.7
    assert toxicity.score(edges, model).count() == len(ROWS) and toxicity.score(nothing, model).count() == 0
    assert {round(r["score"], 6) for r in toxicity.score(edges, toxicity.fit(df.limit(0))).collect()} == {round(1 / (1 + math.e), 6)}


def plain_loss(x, labels, copies, pairs, weights):
    """The loss by its definition, on a dense table, with its gradient and curvature."""
    w, b = weights[:-1], weights[-1]
    one = np.append(x, np.ones((len(x), 1)), axis=1)
    q = 1 / (1 + np.exp(-(x @ w + b)))
    share = copies * np.where(labels > 0, 0.5 / (copies @ labels), 0.5 / (copies @ (1 - labels)))
    loss = -(share @ np.where(labels > 0, np.log(q), np.log(1 - q))) + toxicity.RIDGE / 2 * w @ w
    grad, curve = one.T @ (share * (q - labels)), one.T @ (one * (share * q * (1 - q))[:, None])
    grad[:-1] += toxicity.RIDGE * w
    curve[:-1, :-1] += toxicity.RIDGE * np.eye(len(w))
    if pairs:
        d, many = np.array([x[i] - o for i, o in pairs]), copies[[i for i, _ in pairs]]
        many = many / many.sum()
        loss += toxicity.PENALTY * many @ (d @ w) ** 2
        grad[:-1] += 2 * toxicity.PENALTY * d.T @ (many * (d @ w))
        curve[:-1, :-1] += 2 * toxicity.PENALTY * d.T @ (d * many[:, None])
    return loss, grad, curve


def test_toxicity_weights_against_a_plain_solver(monkeypatch):
    r = np.random.default_rng(8)
    x, labels, copies = (r.random((80, 6)) < 0.4).astype(float), (r.random(80) < 0.4).astype(float), r.integers(1, 5, 80).astype(float)
    swapped = [x[i, [1, 0, 2, 3, 4, 5]] if x[i, 0] != x[i, 1] else None for i in range(80)]
    sets = lambda row: [int(i) for i in np.flatnonzero(row)]
    monkeypatch.setattr(toxicity, "RIDGE", 0.01)
    w, b = toxicity._solve(6, labels, copies, [sets(row) for row in x], [None if s is None else sets(s) for s in swapped])
    pairs, best = [(i, s) for i, s in enumerate(swapped) if s is not None], np.zeros(7)
    for _ in range(50):
        _, grad, curve = plain_loss(x, labels, copies, pairs, best)
        best = best - np.linalg.solve(curve, grad)
    assert np.allclose(np.append(w, b), best, atol=2e-3)
    assert plain_loss(x, labels, copies, pairs, np.append(w, b))[0] <= plain_loss(x, labels, copies, pairs, best)[0] + 1e-6


def test_one_text_of_half_the_labels_stays_one_example(spark):
    rows = [(t, l) for _, t, l in labelled_rows()]
    df = spark.createDataFrame(rows + [("plain1 plain2 scum", 1)] * 600, "text string, toxic int")
    seen, solve = [], toxicity._solve
    try:
        toxicity._solve = lambda n, labels, copies, own, other: seen.append((len(labels), int(copies.sum()))) or solve(n, labels, copies, own, other)
        model = toxicity.fit(df)
        toxicity.fit(df, fit_rows=30)
    finally:
        toxicity._solve = solve
    assert seen[0] == (601, 1200) and 5 <= seen[1][0] <= 80
    score = {r["text"]: r["score"] for r in toxicity.score(df.select("text").distinct(), model).collect()}
    assert all((score[t] >= 0.7) == bool(l) for t, l in rows)


def test_registered_toxicity_query(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in queries.QUERIES["op6_toxicity"](spark, sf_dir).collect()}
    assert set(out) == {r[0] for r in documents.select("doc_id").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in out and r["toxic"] is not None}
    for d, o in out.items():
        assert o["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= o["score"] <= 1 and o["predicted"] == int(o["score"] >= 0.7)
    held = [(toxic[d] > 0, o["score"]) for d, o in out.items() if o["held_out"] and d in toxic]
    good, bad = [s for t, s in held if not t], [s for t, s in held if t]
    assert good and bad and sum((a > b) + 0.5 * (a == b) for a in bad for b in good) >= 0.9 * len(good) * len(bad)


def plain_context_tree(training, texts, depth=context_trees.DEPTH):
    """Context-tree weighting by its definition, with dictionaries."""
    counts = {}
    bits = lambda c: [(1 << t | c >> (8 - t), (c >> (7 - t)) & 1) for t in range(8)]
    for t in training:
        data = bytes(depth) + t.encode() + b"\xff"
        for i in range(depth, len(data)):
            for node, bit in bits(data[i]):
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], node), [0, 0])[bit] += 1
    kids = {}
    for c, node in counts:
        if c:
            kids.setdefault((c[1:], node), []).append((c, node))
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    weighted = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted[k] for k in kids.get(key, []))) - math.log(2)
    out = []
    for t in texts:
        data, total = bytes(depth) + t.encode() + b"\xff", 0.0
        for i in range(depth, len(data)):
            for node, bit in bits(data[i]):
                q = 0.5
                for d in range(depth, -1, -1):
                    key = (data[i - d : i], node)
                    if key not in counts:
                        q = 0.5
                        continue
                    c = counts[key]
                    share = math.exp(kt(*c) - weighted[key] - math.log(2)) if d < depth else 1.0
                    q = share * (c[bit] + 0.5) / (sum(c) + 1) + (1 - share) * q
                total += math.log10(q)
        out.append(total)
    return out


def plain_base(training, texts):
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    c = Counter(w for t in training for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for t in texts]


@pytest.mark.parametrize("leaves", [context_trees.MOST_LEAVES, 0])
def test_context_trees_by_definition(spark, edges, nothing, monkeypatch, leaves):
    monkeypatch.setattr(context_trees, "MOST_LEAVES", leaves)  # with 0 all is asked for by a shuffle
    small = edges.filter("length(text) < 1500 or text is null")
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 1500]
    out = context_trees.score_texts(small, lambda i: i % 7 == 2).collect()
    held = [r[0] is not None and r[0] % 7 == 2 for r in rows]
    training = [r[1] or "" for r, h in zip(rows, held, strict=True) if not h]
    base, trees = plain_base(training, [r[1] for r in rows]), plain_context_tree(training, [r[1] or "" for r in rows])
    expected = sorted((str(r[0]), h, *b[:3], round(b[3], 5), round(s, 4)) for r, h, b, s in zip(rows, held, base, trees, strict=True))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 4)) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert np.allclose([x[5] for x in got], [x[5] for x in expected], atol=1e-4) and np.allclose([x[6] for x in got], [x[6] for x in expected], rtol=1e-4, atol=1e-3)
    if leaves:
        assert context_trees.score_texts(nothing, lambda i: i % 7 == 2).count() == 0


def test_texts_are_a_law_and_the_way_of_lookup_changes_nothing(spark, monkeypatch):
    texts = ["".join(t) for n in range(5) for t in itertools.product("abc", repeat=n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, None if i % 5 == 0 else "abab"[: i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {}
    for leaves in (context_trees.MOST_LEAVES, 0):
        monkeypatch.setattr(context_trees, "MOST_LEAVES", leaves)
        out = context_trees.score_texts(df, lambda i: i < 1000).collect()
        scores[leaves] = {r["doc_id"]: r["score"] for r in out}
    few, more = scores.values()
    assert all(math.isclose(few[i], more[i], rel_tol=1e-12) for i in few)
    chance = [10 ** few[i] for i in range(len(texts))]
    assert few[0] == few[1000] and 0.1 < chance[0] < 1  # the empty text pays for its end
    assert 0.5 < sum(chance) <= 1


def test_chances_of_all_bytes_sum_to_one():
    owner, keys = context_trees.keys_of([b"the thing that then thawed", b"an anthem"])
    k, n = np.unique(keys, return_counts=True)
    tree = context_trees.Trees(k, n)
    top = context_trees.top_levels(list(zip(*[x.tolist() for x in tree.tops()], strict=True)))
    for context in (b"the t", b"zzzzz", b"\0\0\0\0t"):
        each = np.array([context_trees.keys_of([context + bytes([b])])[1][-1] for b in range(256)])
        assert math.isclose(np.exp(tree.log_probability(each, top)).sum(), 1.0, rel_tol=1e-9)




def test_sizes_of_a_mixture_are_counted_once(spark, edges, sf_dir):
    """The mixture reads the written sizes; no text is in its plan."""
    assert all("sizes-" in f for f in queries.op4_mixing(spark, sf_dir).inputFiles())
    out = mixing.mixed_copies(edges, lambda df: df.withColumn("_quality", F.lit(1.0)))
    assert not re.search("split|regexp", out._jdf.queryExecution().optimizedPlan().toString())


def test_copies_of_a_mixture(spark, edges, nothing):
    rated = lambda df: df.withColumn("_quality", F.when(F.col("doc_id") % 2 == 0, 2.0))
    out = mixing.mixed_copies(edges, rated)
    assert out.columns == edges.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter((r["doc_id"], r["text"]) for r in mixing.mixed_copies(edges.repartition(5), rated).collect())
    rows, size = Counter((r[0], r[1]) for r in ROWS), lambda t: len(WORD.findall(t or ""))
    assert set(got) <= set(rows) and all(n <= 2 * rows[r] for r, n in got.items()) and not any(size(r[1]) == 0 for r in got)
    plan = {r["source"]: r for r in mixing.mix(with_weights(edges), native.n_words(F.col("text")), F.col("_q"), ["doc_id"]).collect()}
    for source, t in plan.items():
        mine = sum(n * size(r[1]) for r, n in got.items() if next(x[3] for x in ROWS if x[:2] == r) == source)
        longest = max(size(r[1]) for r in ROWS if r[3] == source)
        assert abs(mine - t["target"]) <= longest  # the document at the boundary is whole or not
    assert mixing.mixed_copies(nothing, rated).count() == 0
    # repeated rows: three copies of one document are to be taken from two equal rows
    twice = spark.createDataFrame([(1, "a b c d", "s")] * 2, "doc_id long, text string, source string")
    assert mixing.mixed_copies(twice, rated).count() == 3
