"""Exact order statistics that spread one large group over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values per group; their bounds are approximate quantiles of the group's distinct values.
BINS = 256


def with_counts_below(
    counts: DataFrame, by: list[str], value: str = "value", count: str = "c"
) -> DataFrame:
    """Add ``below`` (weight of strictly smaller values), ``n`` (total weight), ``lowest`` and ``highest``.

    ``counts`` holds each distinct value of a group once. Values are cut into bins with about equally
    many distinct values, however skewed they are: bin totals are accumulated over at most ``BINS``
    rows per group, and the running sum inside a bin is taken per (group, bin), so a hot group is
    worked on by many tasks.
    """
    spans = counts.groupBy(*by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(count).alias("n"),
        F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 10 * BINS).alias("_cuts"),
    )
    binned = counts.join(spans, by).withColumn("_bin", F.expr(f"size(filter(_cuts, c -> c <= `{value}`))")).drop("_cuts")
    totals = binned.groupBy(*by, "_bin").agg(F.sum(count).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_bin", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .join(starts, [*by, "_bin"])
        .withColumn("below", F.col("_start") + F.col("_in"))
        .withColumnsRenamed({"_lo": "lowest", "_hi": "highest"})
        .drop("_bin", "_start", "_in")
    )


def exact_quantiles(
    counts: DataFrame,
    by: list[str],
    probabilities: dict[str, float],
    value: str = "value",
    count: str = "c",
    moments: bool = False,
) -> DataFrame:
    """Quantiles with linear interpolation from (group, value, count) rows, one row per group.

    ``moments`` adds count, mean, std (n-1), min and max from the same aggregate; sums are taken
    from the smallest value, so a large common offset costs no digits.
    """
    placed = with_counts_below(counts, by, value, count)
    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("n") - 1)
        for tag, target in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (F.col("below") <= target) & (target < F.col("below") + F.col(count))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{tag}"))
    offset = F.col(value) - F.col("lowest")
    sums = [
        F.min("lowest").alias("min"), F.max("highest").alias("max"),
        F.sum(F.col(count) * offset).alias("_s1"), F.sum(F.col(count) * offset * offset).alias("_s2"),
    ] if moments else []
    picked = placed.groupBy(*by).agg(F.max("n").alias("_n"), *sums, *picks)
    outputs = []
    if moments:
        n, s1 = F.col("_n"), F.col("_s1")
        variance = F.greatest((F.col("_s2") - s1 * s1 / n) / (n - 1), F.lit(0.0))
        outputs = [
            n.alias("count"), (F.col("min") + s1 / n).alias("mean"), F.when(n > 1, F.sqrt(variance)).alias("std"), "min", "max",
        ]
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*by, *outputs)
