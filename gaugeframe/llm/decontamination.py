"""Documents that hold an item of a benchmark, exactly or nearly: windows of the item's size, by SimHash and then exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.native import CONTROLS
from gaugeframe.llm.storage import stored

SHINGLE = 5
PERCENT = 75
BITS = 64
#: Of `blocks` only; `matches` goes by no radius, as repeated shingles can put a match beyond any.
RADIUS = 23
#: Item shingles (8 bytes each), documents with a candidate (8) and matched documents (16) are broadcast up to this count; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def lower_words(text: Column) -> Column:
    """Words of a text in lower case, see `native.words`; a null or blank text has none."""
    # where all white space is a blank, the split needs no regular expression
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), CONTROLS, " ")
    return F.array_remove(F.split(spaced, " "), "")


def shingle_hashes(tokens: Column, k: int) -> Column:
    """Hashes of all k words in a row; none if there are fewer."""
    return F.when(
        F.size(tokens) >= k, F.transform(F.sequence(F.lit(0), F.size(tokens) - k), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))
    ).otherwise(F.array().cast("array<bigint>"))


def votes(column: str) -> Column:
    """For each of 64 bits, how many more hashes of an array have it than lack it."""
    return F.expr(f"transform(sequence(0, {BITS - 1}), b -> aggregate({column}, 0, (a, h) -> a + cast(shiftrightunsigned(h, b) & 1L as int) * 2 - 1))")


def simhash(column: str) -> Column:
    """64 majority bits of an array of hashes; a shingle votes as often as it occurs."""
    return F.expr(
        f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | if(aggregate({column}, 0, (a, h) -> a"
        f" + cast(shiftrightunsigned(h, b) & 1L as int) * 2 - 1) > 0, shiftleft(1L, b), 0L))"
    )


def blocks(fingerprint: Column) -> Column:
    """RADIUS + 1 blocks of the bits: two fingerprints with at most RADIUS different bits agree in one of them."""
    cuts = [i * BITS // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(
        *[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    )


def overlap(a: str, b: str) -> Column:
    """Sum over shingles of the lesser count in the two arrays."""
    return F.expr(f"aggregate(array_distinct({b}), 0, (acc, t) -> acc + least(size(filter({a}, x -> x = t)), size(filter({b}, x -> x = t))))")


def matches(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The best window of each document and item: doc_id, item_id, start_word, n_words, hamming, similarity, node.

    A document of (doc_id, text) matches an item of (item_id, text) if some window of it, as many words as the item,
    has a weighted shingle similarity of `percent` % or more: sum of the lesser over sum of the greater counts of five-word
    shingles (all words, if the item has fewer), in lower case. A document with fewer words is one window.

    Windows are all starts with as many shingles of the item, in any order, as that similarity takes; others cannot reach
    it. Of these, a window is dropped if its SimHash differs from the item's in a bit whose votes a match cannot turn; the
    rest are compared by their counts. Neither step loses a match, and no radius of bits decides.

    Null, empty and blank texts match nothing, on both sides. Rows equal in doc_id and text give one result; `node` is a
    hash of the text and tells rows with equal or null doc_ids apart. Equal items each match. Empty tables give an empty
    result. Other columns are not used.
    """
    keyed = documents.select("doc_id", F.col("text")).withColumn("node", F.xxhash64("text"))
    sized = items.select("item_id", lower_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).filter("n_words > 0")
    sized = sized.withColumn("k", F.least("n_words", F.lit(SHINGLE))).withColumn("item", F.xxhash64("words"))
    sizes = sorted(r[0] for r in sized.select("k").distinct().collect()) or [SHINGLE]  # five values at most
    by_size = lambda tokens, k: F.coalesce(*[F.when(k == s, shingle_hashes(tokens, s)) for s in sizes])
    wanted = sized.dropDuplicates(["item"]).select("item", "n_words", "k", by_size(F.col("words"), F.col("k")).alias("item_hashes"))
    placed = wanted.select("item", "n_words", "k", F.explode(F.array_distinct("item_hashes")).alias("hash"))
    few = placed.count() <= MOST_BROADCAST
    at_hand = F.broadcast if few else lambda df: df
    hits = None
    # exploding an array of one keeps the optimizer from splitting a text once more, to see whether it has words
    split = keyed.select("doc_id", "node", F.explode(F.array(lower_words(F.col("text")))).alias("words"))
    for k in sizes:
        # a row for each start, hashed there: in compiled code, unlike a function over the array
        tokens = split.select("doc_id", "node", "words", F.posexplode("words").alias("at", "_first")).filter(F.col("at") <= F.size("words") - k)
        shingle = F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(k)])
        here = tokens.select("doc_id", "node", F.size("words").alias("n"), "at", shingle.alias("hash"))
        here = here.join(at_hand(placed.filter(F.col("k") == k)), "hash")
        hits = here if hits is None else hits.union(here)
    # places are a set, as equal rows give each of them again
    shared = hits.groupBy("doc_id", "node", "item", "n_words", "k").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("at")).alias("at"))
    shared = shared.withColumn("size", F.least("n", "n_words") - F.col("k") + 1)  # shingles of a window
    shingles = F.col("size") + F.col("n_words") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.floor((shingles * percent + 99 + percent) / (100 + percent)).cast("int"))
    shared = shared.withColumn("need", need).filter(F.size("at") >= F.col("need"))
    # the starts whose windows hold places i to i + need - 1, without those of i - 1
    last = "greatest(n - n_words, 0)"
    spans = f"transform(sequence(0, size(at) - need), i -> struct(greatest(at[i + need - 1] - size + 1, 0, if(i > 0, least(at[i - 1], {last}) + 1, 0)) as a, least(at[i], {last}) as b))"
    starts = F.expr(f"flatten(transform(filter({spans}, s -> s.a <= s.b), s -> sequence(s.a, s.b)))")
    spread = shared.select("doc_id", "node", "k", F.struct("item", "n_words", "size", "need", starts.alias("starts")).alias("w"))
    per_document = spread.filter(F.size("w.starts") > 0).groupBy(F.col("doc_id").alias("id"), "node", "k").agg(F.collect_list("w").alias("windows"))
    per_document = stored(per_document, "candidates")
    # of a text without a candidate nothing is shuffled
    candidates = keyed.join(F.broadcast(per_document.select("node")), "node", "left_semi") if per_document.count() <= MOST_BROADCAST else keyed
    found = candidates.alias("d").join(per_document.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.id")) & (F.col("d.node") == F.col("w.node")))
    # a document is split and hashed once: exploding keeps the optimizer from moving these into the expressions that use them
    chosen = found.select("d.doc_id", "d.node", "w.windows", "w.k", F.explode(F.array(lower_words(F.col("d.text")))).alias("words"))
    hashed = chosen.select("doc_id", "node", "windows", F.explode(F.array(by_size(F.col("words"), F.col("k")))).alias("all"))
    held = F.expr("flatten(transform(windows, w -> transform(w.starts, s -> struct(w.item, w.n_words, w.size, w.need, s as start, slice(all, s + 1, w.size) as hashes))))")
    cut = hashed.select("doc_id", "node", F.inline(held))
    # written, as the optimizer would otherwise copy the whole expression of a mark into each of its uses
    marked = stored(cut.withColumn("mark", simhash("hashes")), "windows")
    wanted = wanted.select("item", "item_hashes", votes("item_hashes").alias("item_votes"), simhash("item_hashes").alias("item_mark"))
    near = marked.join(at_hand(wanted), "item").withColumn("hamming", F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))))
    near = near.withColumn("turned", F.col("size") + F.size("item_hashes") - 2 * F.col("need")).filter(
        f"not exists(sequence(0, {BITS - 1}), b -> abs(item_votes[b]) > turned and (shiftrightunsigned(mark ^ item_mark, b) & 1L) = 1L)"
    )
    both = near.withColumn("_both", overlap("hashes", "item_hashes")).withColumn("_all", F.size("hashes") + F.size("item_hashes") - F.col("_both"))
    alike = both.filter(F.col("_both") * 100 >= F.col("_all") * percent).withColumn("similarity", F.col("_both") / F.col("_all"))
    best = alike.groupBy("doc_id", "node", "item").agg(F.max(F.struct("similarity", -F.col("start"), "n_words", "hamming")).alias("_m"))
    best = best.join(sized.select("item_id", "item").distinct(), "item").groupBy("doc_id", "node", "item_id").agg(F.max("_m").alias("_m"))
    return best.select(
        "doc_id", "item_id", (-F.col("_m.col2")).cast("long").alias("start_word"), F.col("_m.n_words").cast("long").alias("n_words"),
        F.col("_m.hamming").alias("hamming"), F.col("_m.similarity").alias("similarity"), "node",
    )


def decontaminate(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, that match no item (see `matches`). Up to MOST_BROADCAST matches (two longs each, counted
    first) are sent to the documents, so that no text is shuffled; beyond that both sides meet by a shuffle."""
    found = stored(matches(documents, items, percent).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct(), "found")
    few = found.count() <= MOST_BROADCAST
    same = documents["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(documents["text"]) == found["_node"])
    return documents.join(F.broadcast(found) if few else found, same, "left_anti")
