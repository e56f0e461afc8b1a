"""Fingerprints by consistent weighted sampling: they collide as often as two texts are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a fingerprint; the standard error of a likeness is sqrt(J (1 - J) / SAMPLES).
SAMPLES = 32
#: Bits of a sample kept in the fingerprint.
MARK_BITS = 32
NONE = "-"
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


def _unit(bits: Column, shift: int, width: int) -> Column:
    """`width` bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) / F.lit(float(1 << width))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k of a weighted term, as one number: the smaller, the earlier the term; its low bits name (term, level).

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1), all drawn from the term's hash: t = floor(ln w / r + b) and
    ln a = ln c - r (t - b + 1). The term with the least a wins; term and t are what two texts must share.
    """
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_unit(first, 0, 32) * _unit(first, 32, 32))
    c = -F.log(_unit(second, 0, 24) * _unit(second, 24, 20))
    b = _unit(second, 44, 20)
    level = F.floor(log_weight / r + b)
    order = F.log(c) - r * (level - b + 1.0)
    # 31 bits of order (ln a lies between -200 and 56), above the bits of the mark
    coarse = F.least(F.greatest((order + 200.0) * float(1 << 23), F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("long")
    mark = F.xxhash64(term, level).bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    return F.shiftleft(coarse, MARK_BITS).bitwiseOR(mark)


def signatures(terms: DataFrame, by: list[str], term: str = "term", samples: int = SAMPLES) -> DataFrame:
    """One row per key of `by` with `marks`, an array of `samples` marks: null where the key has no term.

    `terms` has one row per occurrence of a term (a hash); the weight of a term is its count. Both steps are hash
    aggregations that combine before a shuffle, so a term or a key with many rows is no hot spot.
    """
    weighted = terms.groupBy(*by, term).agg(F.log(F.count(F.lit(1)).cast("double")).alias("_lw"))
    least = weighted.groupBy(*by).agg(
        *[F.min(F.when(F.col(term).isNotNull(), sample(F.col(term), F.col("_lw"), k))).alias(f"_m{k}") for k in range(samples)]
    )
    marks = F.array(*[F.col(f"_m{k}").bitwiseAND(F.lit((1 << MARK_BITS) - 1)) for k in range(samples)])
    return least.select(*by, F.when(F.col("_m0").isNotNull(), marks).alias("marks"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples, an unbiased estimate of the generalised Jaccard similarity; two texts without terms are alike."""
    equal = sum(F.when(a[k] == b[k], 1).otherwise(0) for k in range(samples)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal)


def as_text(marks: Column, samples: int = SAMPLES) -> Column:
    digits = [F.lpad(F.lower(F.hex(marks[k])), MARK_BITS // 4, "0") for k in range(samples)]
    return F.when(marks.isNull(), F.lit(NONE)).otherwise(F.concat(*digits))


def id_ranges(ids: DataFrame, column: str, n: int) -> Column:
    """A column that maps an id to one of `n` ranges with about equally many rows; the driver gets the n cuts only."""
    cuts = ids.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    cuts = sorted(set(cuts))
    wide = max(1, round(len(cuts) ** 0.5))
    fine = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if not cuts:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.size(F.filter(longs([f[0] for f in fine]), lambda x: x <= F.col(column)))
    rest = F.size(F.filter(F.element_at(F.array(*map(longs, fine)), at), lambda x: x <= F.col(column)))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * wide + rest)


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """(bucket, at, id, text, next_text, last): documents by ascending id with the text of the next; after the last comes the first.

    Documents are dealt by ranges of ids, each sorted on its own. The first document of every range is also sent to the
    end of the range before it (`last` marks these copies), so no window spans the table. Null ids come last; equal ids
    are ordered by a hash of the text.
    """
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("_h", F.xxhash64("text"))
    keyed = keyed.withColumn("bucket", id_ranges(keyed, "_k", ranges))
    # one row for each range
    firsts = keyed.groupBy("bucket").agg(F.min("_k").alias("_k"))
    hashes = keyed.join(firsts, ["bucket", "_k"], "left_semi").groupBy("bucket", "_k").agg(F.min("_h").alias("_h"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    ends = hashes.select(F.col("_k"), F.col("_h"), before.alias("_to"))
    sent = keyed.join(F.broadcast(ends), ["_k", "_h"]).select("_k", "text", "_h", F.col("_to").alias("bucket"), F.lit(True).alias("last"))
    dealt = keyed.select("_k", "text", "_h", "bucket", F.lit(False).alias("last")).unionByName(sent).repartition(max(1, ranges // 2), "bucket")
    inside = Window.partitionBy("bucket").orderBy("last", "_k", "_h")
    # an id comes from its key, so that all branches read one and the same shuffle
    id_ = F.nullif(F.col("_k"), F.lit(LAST)).alias("id")
    return dealt.select("bucket", F.row_number().over(inside).alias("at"), id_, "text", F.lead("text").over(inside).alias("next_text"), "last")


def with_edited(documents: DataFrame, terms_of, ranges: int, samples: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document.
    `terms_of` maps a text column to the array of its terms; a term's weight is its count. Null texts count as empty; a
    text without terms has the fingerprint "-", alike to others without terms only. Repeated rows each give a row. An
    empty table gives an empty result; other columns are not used. Texts are shuffled once, by ranges of ids; both
    fingerprints, and the next document's, come from that one partitioning.
    """
    base = with_next(documents, ranges)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    kinds = F.when(F.col("last"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))
    )
    terms = (
        base.select("bucket", "at", F.explode(kinds).alias("_x"))
        .select("bucket", "at", F.col("_x.kind").alias("kind"), F.explode_outer(terms_of(F.col("_x.t"))).alias("_w"))
        .select("bucket", "at", "kind", F.when(F.col("_w").isNotNull(), F.xxhash64("_w")).alias("term"))
    )
    signed = signatures(terms, ["bucket", "at", "kind"], samples=samples)
    following = signed.withColumn("_next", F.lead("marks").over(Window.partitionBy("bucket", "kind").orderBy("at")))
    own = lambda c, kind: F.first(F.when(F.col("kind") == kind, F.struct(F.col(c))), ignorenulls=True)
    both = following.groupBy("bucket", "at").agg(own("marks", 0).alias("_o"), own("marks", 1).alias("_e"), own("_next", 0).alias("_n"))
    compared = both.filter(F.col("_e").isNotNull()).select(
        "bucket", "at", as_text(F.col("_o.marks"), samples).alias("fingerprint"), as_text(F.col("_e.marks"), samples).alias("edited_fingerprint"),
        likeness(F.col("_o.marks"), F.col("_e.marks"), samples).alias("near_edited"), likeness(F.col("_o.marks"), F.col("_n._next"), samples).alias("near_next"),
    )
    light = base.filter(~F.col("last")).select(
        "bucket", "at", F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256")
    )
    return light.join(compared, ["bucket", "at"]).drop("bucket", "at")
