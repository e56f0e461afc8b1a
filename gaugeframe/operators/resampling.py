"""Bootstrap intervals, task-sampling stability, convergence, leave-one-out and design guidance."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from gaugeframe.functions.draws import dense_index, digest, index_draws, packed_draws, unpack_steps
from gaugeframe.operators.ranking import (
    TIE_PLACES,
    baseline_rankings,
    kendall_tau,
    pairwise_gaps,
    with_agreement,
    with_rank,
)
from gaugeframe.operators.variance import (
    FACETS,
    centred_level_sets,
    cohens_d,
    design_grid,
    gram,
    present_facets,
    variance_components,
)
from gaugeframe.session import cut_lineage

# distinct values of a bin, which resampling by counts keeps in one array
BIN_VALUES = 10_000
# values of a block that draws look up, and rows up to which all blocks are sent to the draws (8 MB of doubles)
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
LOCAL_ROWS = 1_000_000
# block of values that packed draws are sent to, and drawn values given back at once
WIDE_BITS = 15
DRAWN = 1 << 20


def bootstrap_statistics(
    df: DataFrame,
    value: str,
    id_cols: list[str],
    by: list[str] | None = None,
    n_bootstrap: int = 1000,
    seed: int = 42,
    statistic: Callable[[str], Column] = F.avg,
) -> DataFrame:
    """(by…, iteration, stat): every iteration redraws all rows of its group with replacement.

    Rows lie in blocks of ``BLOCK`` values by a dense index, and a draw looks its value up in its block. Where all rows are few,
    the blocks go to the draws and no draw is shuffled; otherwise the draws go to their blocks, packed to little more than a byte
    each. Work is n_bootstrap x rows, spread evenly. ``statistic`` is any aggregate of a column.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull())
    indexed = dense_index(rows.select(*dict.fromkeys([*by, *id_cols, value])), id_cols, by)
    sizes = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    few = (sizes.agg(F.sum("n").alias("n")).first().n or 0) <= LOCAL_ROWS
    if few:
        draws = index_draws(sizes, by, n_bootstrap, seed)
        placed = draws.select(*by, "iteration", F.shiftright("idx", BLOCK_BITS).alias("_block"), F.col("idx").bitwiseAND(BLOCK - 1).cast("int").alias("_at"))
        joined = placed.join(F.broadcast(value_blocks(indexed, value, by)), [*by, "_block"])
        drawn = joined.select(*by, "iteration", F.col("_values")[F.col("_at")].alias(value))
    else:
        # a null level meets no rows, as in the join
        draws = packed_draws(sizes.dropna(subset=by) if by else sizes, by, n_bootstrap, seed, WIDE_BITS)
        drawn = _drawn_values(draws, value_blocks(indexed, value, by, WIDE_BITS), by, value)
    return drawn.groupBy(*by, "iteration").agg(statistic(value).alias("stat"))


def _drawn_values(draws: DataFrame, blocks: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, iteration, value) of packed draws: a task reads each block's values, then all draws from it, and keeps one block."""
    spark = draws.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = blocks.unionByName(draws, allowMissingColumns=True).repartition(slots, *by, "_block")
    lined = both.sortWithinPartitions(*by, "_block", F.asc_nulls_first("iteration"))
    kept = [*by, "iteration"]
    schema = draws.select(*kept).schema.add(blocks.schema["_values"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = None
        for batch in batches:
            own, packed = batch.column("_values"), batch.column("_steps")
            rows, found, size = [], [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(found))
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in kept], lists], schema.names)

            for row in range(batch.num_rows):
                if not packed[row].is_valid:
                    values = own[row].values
                    continue
                rows.append(row)
                found.append(values.take(pa.array(unpack_steps(packed[row].as_py()))))
                size += len(found[-1])
                if size >= DRAWN:
                    yield flush()
                    rows, found, size = [], [], 0
            if rows:
                yield flush()

    return lined.mapInArrow(look_up, schema).select(*kept, F.explode("_values").alias(value))


def value_blocks(indexed: DataFrame, value: str, by: list[str], bits: int = BLOCK_BITS) -> DataFrame:
    """(by…, _block, _values): values of two to the power ``bits`` consecutive positions ``idx`` in an array."""
    keyed = indexed.select(*by, F.shiftright("idx", bits).alias("_block"), F.struct("idx", F.col(value).alias("v")).alias("_v"))
    packed = keyed.groupBy(*by, "_block").agg(F.array_sort(F.collect_list("_v")).alias("_sorted"))
    return packed.select(*by, "_block", F.col("_sorted.v").alias("_values"))


def resampled_means_by_counts(
    df: DataFrame, value: str, by: list[str] | None = None, n_bootstrap: int = 1000, seed: int = 42
) -> DataFrame:
    """The same law of resampled means from value counts: one multinomial per group and iteration.

    Work is n_bootstrap x distinct values instead of n_bootstrap x rows. The values of a group lie in bins of about ``BIN_VALUES``:
    an iteration first splits its draws over the bins by their counts, then each bin splits its own over its values, which is
    the multinomial over all values. Bins are keys, so a group with any number of values is spread.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull())
    counts = cut_lineage(rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"))
    n_bins = F.ceil(F.col("k") / BIN_VALUES)
    placed = _with_group(counts, sizes.select(*by, n_bins.alias("_bins")), by).withColumn("_bin", F.pmod(F.xxhash64("v"), F.col("_bins")))
    # one array of a bin's values, and one of a group's bins: as long as the values of the group in thousands
    packed = placed.groupBy(*by, "_bin").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("vc"), F.sum("c").alias("w"))
    packed = cut_lineage(packed)
    bins = packed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_bin", "w"))).alias("bw"), F.sum("w").alias("n"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")

    @F.pandas_udf(ArrayType(LongType()))
    def split(keys: pd.Series, iterations: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for k, i, w in zip(keys, iterations, weights, strict=True):
            w = np.asarray(w, dtype=np.int64)
            rng = np.random.default_rng([seed, zlib.crc32(k.encode()), int(i)])
            out.append(rng.multinomial(w.sum(), w / w.sum()) if len(w) > 1 else w)
        return pd.Series(out)

    @F.pandas_udf(DoubleType())
    def redraw(keys: pd.Series, iterations: pd.Series, bin_: pd.Series, draws: pd.Series, values: pd.Series, weights: pd.Series) -> pd.Series:
        sums = []
        for k, i, b, m, v, w in zip(keys, iterations, bin_, draws, values, weights, strict=True):
            w = np.asarray(w, dtype=np.int64)
            rng = np.random.default_rng([seed, zlib.crc32(k.encode()), int(i), int(b) + 1])
            sums.append(float(rng.multinomial(int(m), w / w.sum()) @ np.asarray(v)))
        return pd.Series(sums)

    slots = df.sparkSession.sparkContext.defaultParallelism
    listed = bins.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1)))).repartition(slots, *by, "iteration")
    dealt = listed.select(*by, "iteration", "n", F.col("bw._bin").alias("_names"), split(key, "iteration", F.col("bw.w")).alias("_draws"))
    dealt = dealt.select(*by, "iteration", "n", F.explode(F.arrays_zip("_names", "_draws")).alias("_d"))
    dealt = dealt.select(*by, "iteration", "n", F.col("_d._names").alias("_bin"), F.col("_d._draws").alias("m")).filter("m > 0")
    joined = dealt.join(packed.select(*by, "_bin", "vc"), [*by, "_bin"])
    parts = joined.select(*by, "iteration", "n", redraw(key, "iteration", "_bin", "m", F.col("vc.v"), F.col("vc.c")).alias("s"))
    return parts.groupBy(*by, "iteration").agg((F.sum("s") / F.first("n")).alias("stat"))


def _with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group; without ``by`` there is one group, a single row."""
    return rows.join(groups, by) if by else rows.join(F.broadcast(groups))


def _interval(stats: DataFrame, by: list[str], alpha: float) -> DataFrame:
    # one value per iteration, so the group is as small as n_bootstrap
    p = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    q = stats.groupBy(*by).agg(F.percentile("stat", p).alias("q"), F.count("stat").alias("n_bootstrap"))
    return q.select(*by, F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), "n_bootstrap")


def bootstrap_ci(
    df: DataFrame,
    value: str,
    id_cols: list[str] | None = None,
    by: list[str] | None = None,
    n_bootstrap: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
    statistic: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Percentile interval per group: (by…, statistic, n, ci_lower, ci_upper, n_bootstrap).

    With ``id_cols`` (columns that identify a row) rows are redrawn one by one; without them means
    are redrawn from value counts, which is the cheap way for large groups. A group without values
    gets nulls.
    """
    by = by or []
    if id_cols is None:
        if statistic is not None:
            raise ValueError("a statistic other than the mean needs id_cols")
        stats = resampled_means_by_counts(df, value, by, n_bootstrap, seed)
    else:
        stats = bootstrap_statistics(df, value, id_cols, by, n_bootstrap, seed, statistic or F.avg)
    observed = df.groupBy(*by).agg((statistic or F.avg)(value).alias("statistic"), F.count(value).alias("n"))
    interval = _interval(stats, by, alpha)
    if by:
        return observed.join(interval, by, "left")
    return observed.join(F.broadcast(interval), how="left")


def bootstrap_ci_by(df: DataFrame, factor: str, value: str = "metric_value", **options) -> DataFrame:
    """``bootstrap_ci`` per level of a factor; the level enters every draw's key."""
    levels = df.filter(F.col(factor).isNotNull())
    return bootstrap_ci(levels, value, by=[factor], **options).withColumnRenamed("statistic", "mean")


def task_means(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """model x task means, the input of every task-sampling operator."""
    kept = df.filter(F.col("model").isNotNull() & F.col("task_id").isNotNull())
    return kept.groupBy("model", "task_id").agg(F.avg(value).alias("mean"))


def task_and_prompt_means(df: DataFrame, value: str = "metric_value") -> tuple[DataFrame, DataFrame]:
    """(model x task means, SD of the prompt means) from one pass over the rows."""
    if "prompt_id" not in df.columns:
        return cut_lineage(task_means(df, value)), df.sparkSession.range(1).select(F.lit(None).cast("double").alias("prompt_effect_std"))
    both = cut_lineage(
        df.groupingSets([["model", "task_id"], ["prompt_id"]], "model", "task_id", "prompt_id").agg(
            F.grouping("prompt_id").alias("_by_task"), F.avg(value).alias("mean")
        )
    )
    means = both.filter("_by_task = 1 AND model IS NOT NULL AND task_id IS NOT NULL").select("model", "task_id", "mean")
    prompts = both.filter("_by_task = 0 AND prompt_id IS NOT NULL")
    return means, prompts.agg(F.coalesce(F.stddev_pop("mean"), F.lit(0.0)).alias("prompt_effect_std"))


def subset_means(means: DataFrame, sizes: list[int], n_subsets: int, seed: int) -> DataFrame:
    """(n_requested, subset_index, n_tasks, model, score): model means over tasks drawn without replacement."""
    spark = means.sparkSession
    slots = spark.sparkContext.defaultParallelism
    tasks = means.select("task_id").distinct().repartition(slots, "task_id")
    listed = tasks.withColumn("n_requested", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "subset_index", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1)))
    )
    by = ["n_requested", "subset_index"]
    order = Window.partitionBy(*by).orderBy("_h", "task_id")
    keyed = listed.withColumn("_h", digest(F.lit(seed), F.col("n_requested"), F.col("subset_index"), F.col("task_id")))
    drawn = (
        keyed.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= F.col("n_requested"))
        .withColumn("n_tasks", F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("int"))
    )
    return drawn.join(means, "task_id").groupBy(*by, "n_tasks", "model").agg(F.avg("mean").alias("score"))


def _reference(means: DataFrame) -> DataFrame:
    full = means.groupBy("model").agg(F.avg("mean").alias("full_score"))
    ranked = with_rank(full, score="full_score", name="full_rank")
    return ranked.withColumn(
        "position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("full_rank", "model"))
    )


def task_subsets(
    df: DataFrame, sizes: list[int], n_subsets: int = 1000, seed: int = 20260404, value: str = "metric_value"
) -> DataFrame:
    """Stability of rankings over random task subsets of each size."""
    means, spread = task_and_prompt_means(df, value)
    by = ["n_requested", "subset_index"]
    scored = subset_means(means, sizes, n_subsets, seed).join(_reference(means), "model")
    agreed = with_agreement(with_rank(scored, by), "full_rank", "rank", by, "position", undefined=None)
    per_subset = agreed.groupBy(*by).agg(
        F.max("n_tasks").alias("n_tasks"), F.max("kendall_tau").alias("kendall_tau"),
        F.max("pairwise_reversal_rate").alias("pairwise_reversal_rate"), F.avg("score").alias("overall_pass_at_1"),
    )
    return per_subset.join(F.broadcast(spread)).select(
        "n_tasks", "subset_index", "kendall_tau", "pairwise_reversal_rate", "prompt_effect_std", "overall_pass_at_1",
        F.lit(None).cast("double").alias("g_coefficient_task"),
    )


# Published reliability targets and the share of subsets that must meet them.
KENDALL_TARGETS = (0.90, 0.95)
G_TARGETS = (0.80, 0.90)
SUBSET_SHARE = 0.80


def reliability_thresholds(simulation: DataFrame) -> DataFrame:
    """Smallest size with at least 80% of subsets meeting each target; the G rows stay null."""
    targets = [("kendall_tau", t) for t in KENDALL_TARGETS] + [("g_coefficient_task", t) for t in G_TARGETS]
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("target")) for m, t in targets]))
    met = F.when(F.col("metric") == "kendall_tau", F.col("kendall_tau")).otherwise(F.col("g_coefficient_task"))
    share = (
        simulation.withColumn("_t", listed)
        .select("*", "_t.metric", "_t.target")
        .groupBy("metric", "target", "n_tasks")
        .agg(F.avg(F.coalesce((met >= F.col("target")).cast("double"), F.lit(0.0))).alias("share"))
    )
    enough = F.when(F.col("share") >= SUBSET_SHARE, F.col("n_tasks"))
    return share.groupBy("metric", "target").agg(F.min(enough).alias("recommended_min_tasks_80pct_subsets"))


def rank_uncertainty(simulation: DataFrame) -> DataFrame:
    """Per size: SD of the overall mean and tau quantiles. The SD stands for every model alike, as in the published table."""
    stats = simulation.groupBy("n_tasks").agg(
        F.stddev_samp("overall_pass_at_1").alias("pass_at_1_std"),
        F.percentile("kendall_tau", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"),
    )
    return stats.select(
        "n_tasks", "pass_at_1_std",
        F.col("q")[0].alias("kendall_tau_median"), F.col("q")[1].alias("kendall_tau_p05"), F.col("q")[2].alias("kendall_tau_p95"),
    )


def order_preservation(
    df: DataFrame, deltas: list[float], sizes: list[int], n_subsets: int = 1000, seed: int = 20260404,
    value: str = "metric_value",
) -> tuple[DataFrame, DataFrame]:
    """How many tasks keep the order of every model pair whose full-data gap is at least delta.

    Per subset the widest gap among broken pairs decides all deltas at once: with models in order of
    subset score, a pair is broken when a model scoring no more has the larger full mean, so the
    running maximum of full means minus the model's own gives the widest broken gap.
    """
    means = cut_lineage(task_means(df, value))
    reference = _reference(means)
    scored = subset_means(means, sizes, n_subsets, seed).join(reference.select("model", "full_score"), "model")
    by = ["n_requested", "subset_index"]
    # RANGE takes ties in, so an equal score counts as a broken pair
    below = Window.partitionBy(*by).orderBy(F.round("score", TIE_PLACES)).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    broken = F.round(F.max("full_score").over(below) - F.col("full_score"), TIE_PLACES)
    worst = scored.withColumn("_b", broken).groupBy(*by, "n_tasks").agg(F.max("_b").alias("worst"))
    grid = F.explode(F.array(*[F.lit(d) for d in deltas])).alias("delta")
    full_gaps = pairwise_gaps(means.withColumnRenamed("mean", value), value)
    pairs = full_gaps.select("gap", grid).filter(F.round("gap", TIE_PLACES) >= F.col("delta"))
    pair_counts = pairs.groupBy("delta").agg(F.count(F.lit(1)).alias("pairs"))
    curve = (
        worst.select("n_tasks", "worst", grid)
        .groupBy("delta", "n_tasks")
        .agg(F.avg((F.col("worst") < F.col("delta")).cast("double")).alias("preserve_rate"))
        .join(F.broadcast(pair_counts), "delta")
    )
    enough = F.when(F.round("preserve_rate", TIE_PLACES) >= SUBSET_SHARE, F.col("n_tasks"))
    smallest = curve.groupBy("delta").agg(F.max("pairs").alias("pairs"), F.min(enough).alias("nt_80"))
    widest = full_gaps.agg(F.max("gap").alias("max_gap"))
    return curve, smallest.join(F.broadcast(widest))


# The published prefix sizes.
CONVERGENCE_SIZES = (100, 250, 500, 1000, 1500, 2000, 3000, 4000, 5000, 6000)


def nested_prefixes(df: DataFrame, id_cols: list[str], sizes: tuple[int, ...], seed: int) -> DataFrame:
    """Rows of the first max(sizes) in random (md5) order, repeated for every size they belong to."""
    ranked = dense_index(df, id_cols, seed=seed, limit=max(sizes))
    return (
        ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .filter(F.col("idx") < F.col("size"))
        .drop("idx")
    )


def convergence(
    df: DataFrame,
    id_cols: list[str],
    sizes: tuple[int, ...] = CONVERGENCE_SIZES,
    seed: int = 42,
    n_bootstrap: int = 500,
    value: str = "metric_value",
    by_rows: bool = True,
) -> DataFrame:
    """Ranking, components, interval and effect sizes on nested random prefixes of the rows.

    ``max_partial_eta_squared`` comes from ``regression.max_partial_eta`` on ``nested_prefixes``.
    """
    by = ["size"]
    part = cut_lineage(nested_prefixes(df, id_cols, sizes, seed))
    full = baseline_rankings(df, value).select("model", F.col("rank").alias("full_rank"))
    scores = part.groupBy("size", "model").agg(F.avg(value).alias("score"))
    aligned = with_rank(scores, by).join(full, "model")
    common = aligned.groupBy("size").agg(F.count(F.lit(1)).alias("_m"))
    tau = kendall_tau(aligned, "full_rank", "rank", by).join(common, by).select(
        "size", F.when(F.col("_m") >= 2, F.col("kendall_tau")).alias("kendall_tau_vs_full_ranking")
    )
    names = [f for f in FACETS if f in df.columns]
    long = variance_components(part, names, by, value)

    def pick(k: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("component") == k, F.col("variance"))), F.lit(0.0))

    wide = long.groupBy("size").agg(
        F.max("n").alias("n_observations"), pick("model").alias("model_variance"),
        pick("prompt_id").alias("prompt_variance"), pick("task_id").alias("task_variance"),
        pick("residual").alias("residual_variance"), F.greatest(pick("total"), F.lit(1e-12)).alias("_t"),
    )
    interval = bootstrap_ci(
        part, value, id_cols if by_rows else None, by, n_bootstrap=n_bootstrap, seed=seed
    ).select("size", F.col("ci_lower").alias("mean_metric_ci_lower"), F.col("ci_upper").alias("mean_metric_ci_upper"))
    effects = cohens_d(part, ["model", "prompt_id"], value, by).groupBy("size").agg(
        F.max(F.when(F.col("factor") == "model", F.col("cohens_d"))).alias("cohens_d_model"),
        F.max(F.when(F.col("factor") == "prompt_id", F.col("cohens_d"))).alias("cohens_d_prompt"),
    )
    return (
        wide.join(tau, by, "left").join(interval, by, "left").join(effects, by, "left")
        .select(
            "size", "n_observations", "kendall_tau_vs_full_ranking", "model_variance", "prompt_variance",
            "task_variance", "residual_variance",
            (100.0 * F.col("model_variance") / F.col("_t")).alias("explained_variance_model_pct"),
            (100.0 * F.col("prompt_variance") / F.col("_t")).alias("explained_variance_prompt_pct"),
            "mean_metric_ci_lower", "mean_metric_ci_upper", "cohens_d_model", "cohens_d_prompt",
        )
    )


def stable_size(convergence_table: DataFrame, tau: float = 0.95) -> DataFrame:
    """Smallest n whose tau reaches the target, else the largest n."""
    hit = F.when(F.col("kendall_tau_vs_full_ranking") >= tau, F.col("n_observations"))
    return convergence_table.agg(F.coalesce(F.min(hit), F.max("n_observations")).alias("stable_n"))


# Facet column and the label of its dropped levels.
DROPPED_FACETS = {"model": "model", "prompt_id": "prompt", "task_id": "task", "run_id": "run"}


def leave_one_out(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Ranking and component changes when one level of model, prompt, task or run is left out.

    No level is refitted on rows. One pass gives counts and means for levels, pairs and triples of
    levels; leaving out level d changes a level mean only where (level, d) was observed, and the
    components follow from those changes. Pairs of levels meet the dropped levels seen with the first of them, of other
    facets than their own, so work grows with observed pairs and triples.
    """
    facets = present_facets(df)
    # means are taken from the grand mean, as only differences matter and squares of large means would cancel
    g = cut_lineage(centred_level_sets(df, facets, (0, 1, 2, 3), value))
    drop_labels = {f: DROPPED_FACETS[f] for f in facets if f in DROPPED_FACETS}
    n_pairs = len(facets) * (len(facets) - 1) // 2
    total = g.filter("f0 IS NULL").select(F.col("n").alias("n_all"), F.col("mean").alias("m"), F.col("var").alias("v"))
    single = g.filter("f0 IS NOT NULL AND f1 IS NULL").select(
        F.col("f0").alias("f"), F.col("l0").alias("l"), "n", F.col("mean").alias("a"), F.coalesce("var", F.lit(0.0)).alias("v")
    )
    pair = g.filter("f1 IS NOT NULL AND f2 IS NULL")
    triple = g.filter("f2 IS NOT NULL")
    # every pair in both directions: (f, l) seen together with (g, k)
    directed = pair.select(
        F.explode(
            F.array(
                F.struct(F.col("f0").alias("f"), F.col("l0").alias("l"), F.col("f1").alias("g"), F.col("l1").alias("k")),
                F.struct(F.col("f1").alias("f"), F.col("l1").alias("l"), F.col("f0").alias("g"), F.col("l0").alias("k")),
            )
        ).alias("p"),
        F.col("n").alias("n_lk"), F.col("mean").alias("a_lk"),
    ).select("p.f", "p.l", "p.g", "p.k", "n_lk", "a_lk")
    is_drop = F.col("g").isin(*drop_labels)
    # observed (level, dropped level): the level's mean without the dropped rows
    left = F.col("n") - F.col("n_lk")
    changed = F.when(left > 0, (F.col("n") * F.col("a") - F.col("n_lk") * F.col("a_lk")) / left).otherwise(F.col("a"))
    obs = cut_lineage(
        directed.filter(is_drop).join(single.select("f", "l", "n", "a"), ["f", "l"]).select(
            "f", "l", F.col("g").alias("drop_f"), F.col("k").alias("drop_l"), "n", "a", "n_lk", left.alias("left"), changed.alias("b")
        )
    )
    # change of sum n*mean^2 per facet
    q_change = F.when(F.col("left") > 0, F.col("left") * F.col("b") * F.col("b")).otherwise(0.0) - F.col("n") * F.col("a") * F.col("a")
    sq_change = obs.groupBy("drop_f", "drop_l", "f").agg(F.sum(q_change).alias("dq"))
    # cross products: sum over facet pairs of sum n_lm a_l a_m, and its change
    other = single.select(F.col("f").alias("g"), F.col("l").alias("k"), F.col("a").alias("a_k"))
    seen_with = directed.join(other, ["g", "k"]).groupBy("f", "l", "g").agg(F.sum(F.col("n_lk") * F.col("a_k")).alias("w"))
    reach = seen_with.groupBy("f", "l").agg(F.sum("w").alias("w"))
    x0 = (
        reach.join(single.select("f", "l", "a"), ["f", "l"]).agg((F.sum(F.col("a") * F.col("w")) / 2).alias("x0"))
    )
    linear = obs.join(reach, ["f", "l"]).groupBy("drop_f", "drop_l").agg(
        F.sum((F.col("b") - F.col("a")) * F.col("w")).alias("t1"),
    )
    own = obs.join(
        single.select(F.col("f").alias("drop_f"), F.col("l").alias("drop_l"), F.col("a").alias("a_d")), ["drop_f", "drop_l"]
    ).groupBy("drop_f", "drop_l").agg(F.sum(F.col("a_d") * F.col("n_lk") * F.col("b")).alias("t4"))
    o0 = obs.select("drop_f", "drop_l", F.col("f").alias("f0"), F.col("l").alias("l0"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    o1 = obs.select("drop_f", "drop_l", F.col("f").alias("f1"), F.col("l").alias("l1"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    # a level is never seen with another level of its facet, so a pair meets dropped levels of the other facets only
    others = F.filter(F.array(*[F.lit(f) for f in drop_labels]), lambda x: (x != F.col("f0")) & (x != F.col("f1")))
    second = (
        pair.select("f0", "l0", "f1", "l1", F.col("n").alias("n_lm"), F.explode(others).alias("drop_f"))
        .join(o0, ["f0", "l0", "drop_f"])
        .join(o1, ["drop_f", "drop_l", "f1", "l1"])
        .groupBy("drop_f", "drop_l")
        .agg(F.sum(F.col("n_lm") * (F.col("b0") - F.col("a0")) * (F.col("b1") - F.col("a1"))).alias("t2"))
    )

    def seat(a: int, b: int, drop: int) -> Column:
        return F.struct(
            F.col(f"f{a}").alias("f0"), F.col(f"l{a}").alias("l0"), F.col(f"f{b}").alias("f1"),
            F.col(f"l{b}").alias("l1"), F.col(f"f{drop}").alias("drop_f"), F.col(f"l{drop}").alias("drop_l"),
        )

    seats = triple.select(F.explode(F.array(seat(0, 1, 2), seat(0, 2, 1), seat(1, 2, 0))).alias("s"), F.col("n").alias("n_lmd"))
    third = (
        seats.select("s.*", "n_lmd")
        .filter(F.col("drop_f").isin(*drop_labels))
        .join(o0, ["drop_f", "drop_l", "f0", "l0"])
        .join(o1, ["drop_f", "drop_l", "f1", "l1"])
        .groupBy("drop_f", "drop_l")
        .agg(F.sum(F.col("n_lmd") * F.col("b0") * F.col("b1")).alias("t3"))
    )
    q0 = single.groupBy("f").agg(F.sum(F.col("n") * F.col("a") * F.col("a")).alias("q"))
    q_wide = q0.agg(*[F.max(F.when(F.col("f") == f, F.col("q"))).alias(f"q_{f}") for f in facets])
    dq_wide = sq_change.groupBy("drop_f", "drop_l").agg(
        *[F.coalesce(F.max(F.when(F.col("f") == f, F.col("dq"))), F.lit(0.0)).alias(f"dq_{f}") for f in facets]
    )
    drops = single.filter(F.col("f").isin(*drop_labels)).select(
        F.col("f").alias("drop_f"), F.col("l").alias("drop_l"), F.col("n").alias("n_d"), F.col("a").alias("a_d"), F.col("v").alias("v_d")
    )
    one_row = total.join(F.broadcast(q_wide)).join(F.broadcast(x0))
    base = drops.join(F.broadcast(one_row)).filter("n_all > n_d")
    for part in (dq_wide, linear, second, third, own):
        base = base.join(part, ["drop_f", "drop_l"], "left")
    zero = {c: 0.0 for c in ("t1", "t2", "t3", "t4", *[f"dq_{f}" for f in facets])}
    base = base.fillna(zero)
    n1 = F.col("n_all") - F.col("n_d")
    m1 = (F.col("n_all") * F.col("m") - F.col("n_d") * F.col("a_d")) / n1
    base = base.withColumn("n1", n1).withColumn("m1", m1)
    center1 = F.col("n1") * F.col("m1") * F.col("m1")
    center0 = F.col("n_all") * F.col("m") * F.col("m")

    def ss_left(f: str) -> Column:
        own_term = F.when(F.col("drop_f") == f, F.col("n_d") * F.col("a_d") * F.col("a_d")).otherwise(0.0)
        return F.col(f"q_{f}") + F.col(f"dq_{f}") - own_term - center1

    def ss_full(f: str) -> Column:
        return F.col(f"q_{f}") - center0

    sst_full = F.col("v") * (F.col("n_all") - 1)
    q_d = F.col("v_d") * (F.col("n_d") - 1) + F.col("n_d") * F.col("a_d") * F.col("a_d")
    sst_left = sst_full + center0 - q_d - center1
    x_left = F.col("x0") + F.col("t1") + F.col("t2") - F.col("t3") - F.col("t4")
    res_left = sst_left - sum(ss_left(f) for f in facets) + 2 * (x_left - n_pairs * center1)
    res_full = sst_full - sum(ss_full(f) for f in facets) + 2 * (F.col("x0") - n_pairs * center0)
    df1, df0 = F.greatest(F.col("n1") - 1, F.lit(1)), F.greatest(F.col("n_all") - 1, F.lit(1))

    def change(f: str) -> Column:
        if f not in facets:
            return F.lit(0.0)
        return F.greatest(ss_left(f) / df1, F.lit(0.0)) - F.greatest(ss_full(f) / df0, F.lit(0.0))

    labels = F.create_map(*[F.lit(x) for kv in drop_labels.items() for x in kv])
    out = base.select(
        "drop_f", "drop_l", F.col("n1").alias("n_observations"),
        change("model").alias("model_variance_change"), change("prompt_id").alias("prompt_variance_change"),
        change("task_id").alias("task_variance_change"),
        (F.greatest(res_left / df1, F.lit(0.0)) - F.greatest(res_full / df0, F.lit(0.0))).alias("residual_variance_change"),
    )
    # model means without the dropped level; one small list of models per dropped level
    models = with_rank(single.filter("f = 'model'").select(F.col("l").alias("model"), "n", "a"), score="a", name="full_rank")
    listed = models.agg(F.collect_list(F.struct("model", "n", "a", "full_rank")).alias("ms"))
    spread = drops.join(F.broadcast(listed)).select("drop_f", "drop_l", F.explode("ms").alias("x")).select("drop_f", "drop_l", "x.*")
    moved = obs.filter("f = 'model'").select("drop_f", "drop_l", F.col("l").alias("model"), "left", "b")
    scored = spread.join(moved, ["drop_f", "drop_l", "model"], "left").filter(
        "coalesce(left, n) > 0 AND NOT (drop_f = 'model' AND drop_l = model)"
    ).withColumn("score", F.coalesce("b", "a"))
    by = ["drop_f", "drop_l"]
    ranked = with_rank(scored, by)
    common = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    tau = kendall_tau(ranked, "full_rank", "rank", by).join(common, by).select(
        *by, F.when(F.col("_m") >= 2, F.col("kendall_tau")).alias("kendall_tau_vs_full")
    )
    return out.join(tau, by, "left").select(
        labels[F.col("drop_f")].alias("dropped_factor"), F.col("drop_l").alias("dropped_level"), "n_observations",
        "kendall_tau_vs_full", "model_variance_change", "prompt_variance_change", "task_variance_change",
        "residual_variance_change",
    )


def leave_one_out_summary(table: DataFrame) -> DataFrame:
    """Minimum and median tau per dropped factor. Rows are facet levels, already summarised."""
    return table.groupBy("dropped_factor").agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.min("kendall_tau_vs_full").alias("kendall_tau_min"),
        F.percentile("kendall_tau_vs_full", F.lit(0.5)).alias("kendall_tau_median"),
    )


# Names and states of the guidance rows.
PENDING_TAU = "pending_task_sampling"
PENDING_RUN = "pending_experiment_completion"
NOT_SUPPORTED = "not_supported"
GUIDANCE_GRID = {
    "task_counts": [10, 20, 40, 60, 80, 100, 120, 140, 164],
    "prompt_counts": [1, 2, 4],
    "run_counts": [1, 3, 5],
}


def placeholder_guidance(spark) -> DataFrame:
    """Guidance before any data: six open recommendations."""
    rows = [
        ("minimum_tasks_for_g_0_80", None, NOT_SUPPORTED, "G does not depend on the design"),
        ("minimum_tasks_for_g_0_90", None, NOT_SUPPORTED, "G does not depend on the design"),
        ("minimum_tasks_for_kendall_tau_0_90", None, PENDING_TAU, "needs task sampling"),
        ("minimum_tasks_for_kendall_tau_0_95", None, PENDING_TAU, "needs task sampling"),
        ("marginal_benefit_additional_prompts", None, PENDING_RUN, "needs prompt variance share"),
        ("marginal_benefit_additional_runs", None, PENDING_RUN, "needs run variance share"),
    ]
    return spark.createDataFrame(rows, "recommendation string, value string, status string, notes string")


def tau_minimums(thresholds: DataFrame) -> DataFrame:
    """Tau rows of a thresholds table in any of its three published column layouts."""
    cols = set(thresholds.columns)
    if {"metric", "target", "recommended_min_tasks_80pct_subsets"} <= cols:
        rows = thresholds.filter("metric = 'kendall_tau'").select(
            "target", F.col("recommended_min_tasks_80pct_subsets").alias("n")
        )
    elif {"kendall_tau_target", "min_tasks_80pct_subsets"} <= cols:
        rows = thresholds.select(F.col("kendall_tau_target").alias("target"), F.col("min_tasks_80pct_subsets").alias("n"))
    elif {"metric", "target", "n_tasks", "fraction_meeting_target"} <= cols:
        rows = thresholds.filter("metric = 'kendall_tau_recommendation'").select("target", F.col("n_tasks").alias("n"))
    else:
        raise ValueError(f"unknown thresholds layout: {sorted(cols)}")
    label = F.concat(F.lit("minimum_tasks_for_kendall_tau_"), F.replace(F.col("target").cast("string"), F.lit("."), F.lit("_")))
    return rows.select(
        label.alias("recommendation"), F.col("n").cast("string").alias("value"), F.lit("estimated").alias("status"),
        F.lit("smallest size with 80% of subsets at the target").alias("notes"),
    )


def design_guidance(df: DataFrame, thresholds: DataFrame | None = None, scope: str = "pass_at_1") -> DataFrame:
    """Recommendations (name, value, status) from components and task-sampling thresholds."""
    spark = df.sparkSession
    if df.limit(1).count() == 0:
        return placeholder_guidance(spark)
    facets = present_facets(df)
    components = variance_components(df, facets, summary=gram(df, facets))

    def pick(k: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("component") == k, F.col("variance"))), F.lit(0.0))

    wide = components.agg(*[pick(k).alias(k) for k in (*FACETS, "residual", "total")])
    grid = design_grid(wide, **GUIDANCE_GRID)
    universe = F.col("task_id") + F.col("prompt_id") + F.col("run_id")
    g = F.when(universe + F.col("residual") > 0, universe / (universe + F.col("residual"))).otherwise(0.0)
    flat = grid.agg(F.countDistinct(g).alias("g_values"))
    total = F.greatest(F.col("total"), F.lit(1e-12))

    def share(name: str, facet: str) -> Column:
        value = F.to_json(
            F.struct(
                F.round(100.0 * F.col(facet) / total, 4).alias(f"{name}_variance_share_pct"),
                F.round(F.col(facet), 9).alias(f"{name}_variance"),
            )
        )
        return F.struct(
            F.lit(f"marginal_benefit_additional_{name}s").alias("recommendation"), value.alias("value"),
            F.lit("estimated_descriptive_anova").alias("status"), F.lit("descriptive share, not a reliability gain").alias("notes"),
        )

    def unsupported(target: str) -> Column:
        return F.struct(
            F.lit(f"minimum_tasks_for_g_{target}").alias("recommendation"),
            F.lit(None).cast("string").alias("value"),
            F.lit(NOT_SUPPORTED).alias("status"),
            F.concat(F.lit("distinct G over the grid: "), F.col("g_values")).alias("notes"),
        )

    note = F.struct(
        F.lit("scope_note").alias("recommendation"), F.lit(scope).alias("value"), F.lit("stated").alias("status"),
        F.lit("holds for the analysed design only").alias("notes"),
    )
    rows = wide.join(F.broadcast(flat)).select(
        F.explode(F.array(unsupported("0_80"), unsupported("0_90"), share("prompt", "prompt_id"), share("run", "run_id"), note)).alias("r")
    ).select("r.*")
    if thresholds is not None:
        return rows.unionByName(tau_minimums(thresholds))
    pending = placeholder_guidance(spark).filter(F.col("status") == PENDING_TAU)
    return rows.unionByName(pending)
