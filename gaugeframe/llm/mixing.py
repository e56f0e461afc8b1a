"""A mixture of sources by weight: whole epochs first, then a weighted sample without replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.native import md5_uniform, n_words
from gaugeframe.llm.storage import stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Key ranges of a source, in two levels: no task ever holds a source, only a range of its keys.
COARSE = FINE = 256


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS
) -> DataFrame:
    """Targets of the sources of a table (source, size): one row per source, all windows below run over these few rows.

    The targets share `share` times all sizes by weight and stop at `most_epochs` times the source's size; what is above
    goes to the others by weight until none is above. Sorted by size per weight, a first part of the sources stops at
    its bound and the rest gets one common amount per weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank"), F.lit(len(weights))) + 1)
    ranked = per_source.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", weight)
    bound = F.col("source_size") * F.lit(most_epochs)
    order = Window.orderBy(bound / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))
    levels = ranked.withColumn("_level", left / F.sum("_w").over(onward))
    # the first source that does not reach its bound sets the level of all after it
    open_ = F.when(F.col("_level") * F.col("_w") <= bound, F.struct("_at", "_level"))
    at = levels.withColumn("_at", F.row_number().over(order))
    found = at.withColumn("_open", F.min(open_).over(everything))
    target = F.when(F.col("_open").isNull() | (F.col("_at") < F.col("_open._at")), bound).otherwise(F.col("_open._level") * F.col("_w"))
    return found.select("source", "_rank", "source_size", target.alias("target"))


def mix(
    documents: DataFrame, size: Column, quality: Column, key: list[str], seed: int = 4, weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """All columns of `documents` with `size`, `source_size`, `target` (of its source) and `taken`.

    A source with target T and size S gives floor(T / S) whole epochs; the rest is taken in the order of
    Efraimidis-Spirakis keys -ln(u) / quality (u: an md5 draw of `key`), by prefix sums of sizes up to the rest, so a
    better document comes earlier with the law of weighted sampling without replacement. The document at the boundary
    gives only the words still missing, so the taken words meet the target to the word.

    Prefix sums run in three levels (256 coarse ranges of keys per source, 256 fine ranges in each, the rows of a fine
    range), so a source with a third of all rows is still many small tasks.

    Null sources are one source, after all others. Null texts and texts without words have size 0 and nothing is taken of
    them; a source without words has target 0. Equal keys (repeated rows) are ordered by size, rows equal in both are
    alike. A null or non-positive quality counts as 1. An empty table gives an empty result. Columns with the names of
    the results are replaced.
    """
    inner = documents.drop("size", "source_size", "target", "taken")
    weight = F.when(quality > 0, quality.cast("double")).otherwise(F.lit(1.0))
    draw = md5_uniform(F.lit(seed), *[F.col(f"`{c}`") for c in key])
    rows = inner.select(
        F.struct(*[F.col(f"`{c}`") for c in inner.columns]).alias("_row"), F.col("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        (-F.log(draw) / weight).alias("_key"), draw.alias("_draw"),
    )
    targets = source_targets(rows.select("source", "size"), weights, share, most_epochs)
    # ranges by 1 - exp(-key): monotone in the key, and even when all weights are 1
    leaf = F.least(F.floor((1.0 - F.exp(-F.col("_key"))) * (COARSE * FINE)), F.lit(COARSE * FINE - 1)).cast("int")
    placed = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "_row", "size", "_key", "_rank", "source_size", "target", leaf.alias("_leaf")
    )
    leaves = (
        rows.select("source", "size", leaf.alias("_leaf")).groupBy("source", "_leaf").agg(F.sum("size").alias("_sum"))
        .alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("_rank", "_leaf", "_sum", F.expr(f"_leaf div {FINE}").alias("_coarse"))
    )
    before = lambda *by: Window.partitionBy(*by)
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = leaves.groupBy("_rank", "_coarse").agg(F.sum("_sum").alias("_total"))
    coarse = coarse.select("_rank", "_coarse", F.coalesce(F.sum("_total").over(until(before("_rank").orderBy("_coarse"))), F.lit(0)).alias("_c"))
    fine = leaves.select("_rank", "_coarse", "_leaf", F.coalesce(F.sum("_sum").over(until(before("_rank", "_coarse").orderBy("_leaf"))), F.lit(0)).alias("_f"))
    starts = fine.join(coarse, ["_rank", "_coarse"]).select("_rank", "_leaf", (F.col("_c") + F.col("_f")).alias("_start"))
    inside = until(before("_rank", "_leaf").orderBy("_key", "size"))
    summed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_rank", "_leaf"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    part = F.least(F.greatest(rest - F.col("_start") - F.col("_in"), F.lit(0)), F.col("size"))
    return summed.select("_row.*", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed_copies(documents: DataFrame, rated: Callable[[DataFrame], DataFrame], seed: int = 4) -> DataFrame:
    """The mixture as rows, all columns of (doc_id, text, source): each document as often as `mix` takes its words, to the
    nearest whole document.

    `rated` adds `_quality` to rows of (doc_id, source, _key, _size). Only such rows, without texts, go through the mixture;
    then the documents meet their numbers of copies in one join by doc_id and `_key`, a hash of doc_id, source and text.
    Rows equal in these are alike for the mixture, and what it takes of them together is dealt out evenly over them.

    Null doc_ids differ by their texts. Nulls else, sizes, ties and empty tables are as in `mix`; other columns may have any names.
    """
    text, source = F.col("text"), F.col("source").cast("string")
    known = [F.coalesce(text, F.lit("")), text.isNull(), F.coalesce(source, F.lit("")), source.isNull(), F.col("doc_id").isNull()]
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), *known)
    # written, so that texts are read once for their sizes
    slim = stored(rated(documents.select("doc_id", "source", key.alias("_key"), n_words(text).alias("_size"))), "sizes")
    mixture = mix(slim, F.col("_size"), F.col("_quality"), ["doc_id", "_key"], seed)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    # not null, so that the join and the window below share one partitioning
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")
    wanted = mixture.select(id_of, "_key", times.alias("_n"))
    wanted = wanted.groupBy("_id", "_key").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")).filter("_n > 0")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), id_of, key.alias("_key"))
    met = rows.join(wanted, ["_id", "_key"]).withColumn("_at", F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_key")))
    dealt = met.select("_row", F.expr("cast(_n div _rows + if(_at <= _n % _rows, 1, 0) as int)").alias("_times")).filter("_times > 0")
    return dealt.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
