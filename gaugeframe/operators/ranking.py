"""Model rankings and how fragile they are under resampling.

A resampling iteration is a key, not a loop: draws, scores, ranks and taus of all iterations are
computed together. Kendall's tau counts inversions bit by bit, so no model pairs are formed for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.draws import dense_index, index_draws, normal
from gaugeframe.session import cut_lineage

BOOTSTRAP_FACETS = ("task_id", "prompt_id", "run_id")
FACET_SEED_STEP = 1000
# scores equal to this many places are ties, whatever the order of summation was
TIE_PLACES = 12


def model_scores(df: DataFrame, value: str = "metric_value", model: str = "model") -> DataFrame:
    """Mean score per model, best first."""
    scored = df.filter(F.col(model).isNotNull()).groupBy(F.col(model).alias("model"))
    return scored.agg(F.avg(value).alias("score")).orderBy(F.desc("score"), "model")


def with_rank(scores: DataFrame, by: list[str] | None = None, score: str = "score", name: str = "rank") -> DataFrame:
    """Average rank within ``by``, 1 = best; tied models share the middle rank."""
    key = F.round(F.col(score), TIE_PLACES)
    groups = by or [F.lit(0)]
    ordered = Window.partitionBy(*groups).orderBy(F.desc(key))
    tied = Window.partitionBy(*groups, key)
    return scores.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def baseline_rankings(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """model, score, rank and position (rank order, ties by name)."""
    return _placed(model_scores(df, value))


def _placed(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy("rank", "model")
    return with_rank(scores).withColumn("position", F.row_number().over(order))


def score_matrix(df: DataFrame, row: str, models: list[str] | None = None, value: str = "metric_value") -> DataFrame:
    """row x model means; long when no model list is given, pivoted for a given list."""
    kept = df.filter(F.col(row).isNotNull() & F.col("model").isNotNull())
    if models is None:
        return kept.groupBy(row, "model").agg(F.avg(value).alias("mean"))
    return kept.groupBy(row).pivot("model", models).agg(F.avg(value)).orderBy(row)


def with_agreement(
    ranked: DataFrame,
    x: str,
    y: str,
    by: list[str],
    position: str | None = None,
    undefined: float | None = 1.0,
    name: str = "kendall_tau",
) -> DataFrame:
    """Add tau-b between rank columns ``x`` and ``y`` within ``by`` to every row.

    ``undefined`` covers fewer than two items and all-tied sides. With ``position`` (reference order)
    also ``pairwise_reversal_rate``: the share of pairs whose later item has the strictly better y.

    Both need inversions, pairs that are strictly out of order. Two integer codes first differ at one
    bit, so for every bit the rows sharing the higher bits are scanned in order and each 0 counts the
    1s before it: M log M rows for M items instead of M^2 pairs. Every window is partitioned within
    ``by``, so one shuffle serves all of them.
    """
    group = Window.partitionBy(*by)
    keys = [F.col(c) for c in by]
    columns = list(ranked.columns)
    one = F.lit(1)
    coded = ranked.select(
        *columns,
        F.count(one).over(group).alias("_m"),
        F.count(one).over(Window.partitionBy(*keys, x)).alias("_cx"),
        F.count(one).over(Window.partitionBy(*keys, y)).alias("_cy"),
        F.count(one).over(Window.partitionBy(*keys, x, y)).alias("_cxy"),
        (F.rank().over(Window.partitionBy(*keys).orderBy(y)) - 1).alias("_code"),
    )
    bits = F.length(F.bin(F.col("_m") - 1))
    spread = coded.withColumn("_level", F.explode(F.sequence(F.lit(0), bits.cast("int") - 1)))
    spread = spread.withColumns({"_prefix": F.expr("shiftright(_code, _level + 1)"), "_one": F.expr("shiftright(_code, _level) & 1")})
    part = Window.partitionBy(*keys, "_level", "_prefix")

    def inversions(*order: str) -> Column:
        ones = F.sum("_one").over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return F.when(F.col("_one") == 0, F.coalesce(ones, F.lit(0))).otherwise(0)

    found = {"_q": inversions(x, y)}
    if position is not None:
        found["_flips"] = inversions(position)
    first = F.col("_level") == 0

    def ties(c: str) -> Column:
        return F.sum(F.when(first, F.col(c) - 1).otherwise(0)).over(group) / 2

    totals = {"_tx": ties("_cx"), "_ty": ties("_cy"), "_txy": ties("_cxy"), "_qs": F.sum("_q").over(group)}
    if position is not None:
        totals["_flips_all"] = F.sum("_flips").over(group)
    counted = spread.withColumns(found).withColumns(totals).filter(first)
    n0 = F.col("_m") * (F.col("_m") - 1) / 2
    scale = F.sqrt((n0 - F.col("_tx")) * (n0 - F.col("_ty")))
    agree = n0 - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.col("_qs")
    tau = F.when((F.col("_m") >= 2) & (scale > 0), F.round(agree / scale, TIE_PLACES))
    if undefined is not None:
        tau = F.coalesce(tau, F.lit(undefined))
    out = [tau.alias(name)]
    if position is not None:
        out.append(F.when(n0 > 0, F.col("_flips_all") / n0).alias("pairwise_reversal_rate"))
    return counted.select(*columns, *out)


def kendall_tau(
    pairs: DataFrame, x: str, y: str, by: list[str], undefined: float | None = 1.0, name: str = "kendall_tau"
) -> DataFrame:
    """tau-b between two rank columns, one row per ``by``."""
    rows = with_agreement(pairs.select(*by, x, y), x, y, by, undefined=undefined, name=name)
    return rows.groupBy(*by).agg(F.max(name).alias(name))


def reversal_rate(sample: DataFrame, by: list[str], position: str, score: str) -> DataFrame:
    """Share of model pairs, taken in reference order, whose later model scores strictly higher."""
    ranked = with_rank(sample.select(*by, position, score), by, score, "_rank")
    rows = with_agreement(ranked, position, "_rank", by, position)
    return rows.groupBy(*by).agg(F.max("pairwise_reversal_rate").alias("pairwise_reversal_rate"))


def with_rank_change(samples: DataFrame, by: list[str], base_rank: str, rank: str, position: str) -> DataFrame:
    """Add ``moved``: 1 when a model's first-method integer rank differs from its baseline's.

    Ties are broken by baseline position, so a tie in the resample moves both tied models' order
    only where the baseline did not have it.
    """
    base = Window.partitionBy(*by).orderBy(F.desc(base_rank), position)
    drawn = Window.partitionBy(*by).orderBy(F.desc(rank), position)
    changed = F.row_number().over(base) != F.row_number().over(drawn)
    return samples.withColumn("moved", changed.cast("double"))


def rank_change_rate(samples: DataFrame, by: list[str], base_rank: str, rank: str, position: str) -> DataFrame:
    """Share of models whose integer rank changed, per ``by``."""
    moved = with_rank_change(samples, by, base_rank, rank, position)
    return moved.groupBy(*by).agg(F.avg("moved").alias("rank_change_rate"))


WHOLE = ""


def level_sums(df: DataFrame, facets: list[str], value: str = "metric_value") -> DataFrame:
    """(bootstrap_type, level, model, s, n_rows): level totals of every facet, and of the whole frame
    under the type '', in one pass; written once, because draws, sizes and baseline all read it."""
    levels = F.explode(
        F.array(
            F.struct(F.lit(WHOLE).alias("bootstrap_type"), F.lit(WHOLE).alias("level")),
            *[F.struct(F.lit(f).alias("bootstrap_type"), F.col(f).cast("string").alias("level")) for f in facets],
        )
    )
    rows = df.filter(F.col("model").isNotNull() & F.col(value).isNotNull()).select("model", F.col(value).alias("_y"), levels.alias("_l"))
    sums = (
        rows.select("_l.bootstrap_type", "_l.level", "model", "_y")
        .filter("level IS NOT NULL")
        .groupBy("bootstrap_type", "level", "model")
        .agg(F.sum("_y").alias("s"), F.count("_y").alias("n_rows"))
    )
    return cut_lineage(sums)


def baseline_of(sums: DataFrame) -> DataFrame:
    """Baseline rankings from the whole-frame rows of ``level_sums``."""
    return _placed(sums.filter(F.col("bootstrap_type") == WHOLE).select("model", (F.col("s") / F.col("n_rows")).alias("score")))


def resampled_scores(sums: DataFrame, facets: list[str], n_bootstrap: int, seed: int) -> DataFrame:
    """(bootstrap_type, iteration, model, score) with facet levels drawn with replacement.

    A level drawn twice counts its sums twice; rows are not touched again.
    """
    sums = sums.filter(F.col("bootstrap_type") != WHOLE)
    levels = dense_index(sums.select("bootstrap_type", "level").distinct(), ["level"], ["bootstrap_type"])
    offsets = F.create_map(
        *[F.lit(v) for i, f in enumerate(facets) for v in (f, seed + FACET_SEED_STEP * i)]
    )
    sizes = sums.groupBy("bootstrap_type").agg(F.countDistinct("level").alias("n"))
    draws = index_draws(
        sizes.withColumn("_s", offsets[F.col("bootstrap_type")]), ["bootstrap_type"], n_bootstrap, F.col("_s")
    )
    indexed = sums.join(levels, ["bootstrap_type", "level"])
    return (
        draws.join(indexed, ["bootstrap_type", "idx"])
        .groupBy("bootstrap_type", "iteration", "model")
        .agg((F.sum("s") / F.sum("n_rows")).alias("score"))
    )


def bootstrap_all_facets(
    df: DataFrame,
    facets: list[str] | None = None,
    n_bootstrap: int = 1000,
    seed: int = 42,
    value: str = "metric_value",
) -> DataFrame:
    """Per facet, iteration and model: score, rank, tau to the baseline and whether any rank changed."""
    facets = [f for f in (facets or BOOTSTRAP_FACETS) if f in df.columns]
    if not facets:
        raise ValueError("no resampling facet in the frame")
    by = ["bootstrap_type", "iteration"]
    sums = level_sums(df, facets, value)
    base = baseline_of(sums).select("model", F.col("rank").alias("base_rank"), "position")
    scored = with_rank(resampled_scores(sums, facets, n_bootstrap, seed).join(base, "model"), by)
    moved = with_rank_change(scored, by, "base_rank", "rank", "position")
    changed = moved.withColumn("rank_changed", F.max("moved").over(Window.partitionBy(*by)))
    return with_agreement(changed, "base_rank", "rank", by).select(
        "bootstrap_type", "iteration", "model", "score", "rank", "kendall_tau", "rank_changed"
    )


def bootstrap_rankings(
    df: DataFrame, facet: str, n_bootstrap: int = 1000, seed: int = 42, value: str = "metric_value"
) -> DataFrame:
    """``bootstrap_all_facets`` for one facet."""
    if facet not in df.columns:
        raise ValueError(f"facet column {facet!r} not in the frame")
    return bootstrap_all_facets(df, [facet], n_bootstrap, seed, value)


def rank_probabilities(samples: DataFrame) -> DataFrame:
    """P(model has rank k), long; integer ranks 1..M and every observed half rank appear for each model."""
    counts = samples.groupBy("model", "rank").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("model").agg(
        F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "c"))).alias("seen")
    )
    # one row: all ranks to list; at most two per model
    m = totals.agg(F.count(F.lit(1)).cast("int").alias("m"))
    observed = counts.agg(F.collect_set("rank").alias("ranks"))
    whole = F.transform(F.sequence(F.lit(1), F.col("m")), lambda k: k.cast("double"))
    listed = m.join(F.broadcast(observed)).select(F.array_union(whole, F.col("ranks")).alias("ranks"))
    full = totals.join(F.broadcast(listed)).withColumn("rank", F.explode("ranks"))
    return full.select(
        "model", "rank", (F.coalesce(F.col("seen")[F.col("rank")], F.lit(0)) / F.col("total")).alias("probability")
    )


def pairwise_reversal(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per model pair (better one first): share of iterations where the order is not kept; ties count.

    Iterations with the same ranking are counted together before pairs are listed.
    """
    ranked = samples.join(baseline.select("model", "position"), "model")
    rankings = ranked.groupBy("bootstrap_type", "iteration").agg(
        F.array_sort(F.collect_list(F.struct("position", "model", "rank"))).alias("r")
    )
    patterns = rankings.groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    first = patterns.select("r", "c", F.posexplode("r").alias("i", "a"))
    rest = first.select("c", "a", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("b"))
    lost = (~(F.col("a.rank") < F.col("b.rank"))).cast("int") * F.col("c")
    return rest.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        (F.sum(lost) / F.sum("c")).alias("reversal_probability"), F.sum("c").alias("n_iterations")
    )


def fragility_summary(samples: DataFrame, metric: str) -> DataFrame:
    """Tau mean, population SD and minimum, rank-change rate and fragility index, per facet and overall."""
    per_iteration = samples.groupBy("bootstrap_type", "iteration").agg(
        F.max("kendall_tau").alias("tau"), F.max("rank_changed").alias("changed"), F.count(F.lit(1)).alias("m")
    )
    out = per_iteration.groupingSets([["bootstrap_type"], []], "bootstrap_type").agg(
        F.grouping("bootstrap_type").alias("_all"),
        F.max("m").alias("n_models"),
        F.count(F.lit(1)).alias("n_bootstrap"),
        F.avg("tau").alias("kendall_tau_mean"),
        F.stddev_pop("tau").alias("kendall_tau_std"),
        F.min("tau").alias("kendall_tau_min"),
        F.avg("changed").alias("rank_change_rate"),
    )
    label = F.when(F.col("_all") == 1, "overall").otherwise(F.col("bootstrap_type"))
    return out.select(
        F.lit(metric).alias("metric_name"),
        label.alias("bootstrap_type"),
        "n_models", "n_bootstrap", "kendall_tau_mean", "kendall_tau_std", "kendall_tau_min", "rank_change_rate",
        ((1 - F.col("kendall_tau_mean")) / 2).alias("fragility_index"),
    )


def noise_fragility(
    df: DataFrame, noise_scale: float = 0.01, n_perturbations: int = 1000, seed: int = 42, value: str = "metric_value"
) -> DataFrame:
    """Add normal noise to the model means: share of perturbations with any order change, tau mean and SD."""
    base = with_rank(model_scores(df, value))
    noisy = base.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_perturbations - 1)))).withColumn(
        "noisy", F.col("score") + F.lit(noise_scale) * normal(F.lit(seed), F.col("iteration"), F.col("model"))
    )
    by = ["iteration"]
    ranked = with_rank(noisy, by, "noisy", "noisy_rank")
    first = Window.partitionBy("iteration").orderBy("rank", "model")
    drawn = Window.partitionBy("iteration").orderBy("noisy_rank", "model")
    moved = ranked.withColumn("moved", (F.row_number().over(first) != F.row_number().over(drawn)).cast("int"))
    per_iteration = with_agreement(moved, "rank", "noisy_rank", by).groupBy("iteration").agg(
        F.max("moved").alias("changed"), F.count(F.lit(1)).alias("m"), F.max("kendall_tau").alias("kendall_tau")
    )
    return per_iteration.agg(
        F.max("m").alias("n_models"),
        F.count(F.lit(1)).alias("n_perturbations"),
        F.sum("changed").alias("rank_changes"),
        F.avg(F.col("changed").cast("double")).alias("fragility_rate"),
        F.avg("kendall_tau").alias("kendall_tau_mean"),
        F.stddev_pop("kendall_tau").alias("kendall_tau_std"),
    )


INTERVAL = (0.025, 0.5, 0.975)


def ranking_ci(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals of tau and fragility, and of each model's rank. Groups hold one value per iteration."""
    p = F.array(*[F.lit(q) for q in INTERVAL])
    taus = samples.groupBy("bootstrap_type", "iteration").agg(F.max("kendall_tau").alias("tau"))
    tau_row = taus.agg(F.avg("tau").alias("mean"), F.percentile("tau", p).alias("q")).select(
        F.lit("kendall_tau").alias("metric"), F.col("mean").alias("point_estimate"),
        F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_median"), F.col("q")[2].alias("ci_upper"),
    )
    index = taus.agg(((1 - F.avg("tau")) / 2).alias("point_estimate"))
    # equal taus of several facets count once within an iteration
    distinct = taus.select("iteration", "tau").distinct().groupBy("iteration").agg(
        ((1 - F.avg("tau")) / 2).alias("f")
    )
    frag_row = distinct.agg(F.percentile("f", p).alias("q")).join(F.broadcast(index)).select(
        F.lit("fragility_index").alias("metric"), "point_estimate",
        F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_median"), F.col("q")[2].alias("ci_upper"),
    )
    ranks = samples.groupBy("model").agg(F.percentile("rank", p).alias("q")).select(
        "model", F.col("q")[1].alias("rank_median"), F.col("q")[0].alias("rank_ci_lower"), F.col("q")[2].alias("rank_ci_upper"),
    )
    return tau_row.unionByName(frag_row), ranks


def pairwise_gaps(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Absolute mean difference of every model pair (the result itself is one row per pair)."""
    scores = model_scores(df, value)
    a = scores.select(F.col("model").alias("model_a"), F.col("score").alias("score_a"))
    b = scores.select(F.col("model").alias("model_b"), F.col("score").alias("score_b"))
    gap = F.abs(F.col("score_a") - F.col("score_b"))
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", gap.alias("gap")).orderBy(
        "gap", "model_a", "model_b"
    )


def cluster_ci(
    df: DataFrame, cluster: str = "task_id", n_bootstrap: int = 1000, seed: int = 42, value: str = "metric_value"
) -> DataFrame:
    """Per model: mean and percentile interval from resampling whole clusters."""
    p = F.array(F.lit(0.025), F.lit(0.975))
    sums = level_sums(df, [cluster], value)
    samples = resampled_scores(sums, [cluster], n_bootstrap, seed)
    bounds = samples.groupBy("model").agg(F.percentile("score", p).alias("q"))
    return baseline_of(sums).join(bounds, "model").select(
        "model", F.col("score").alias("mean"), F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper")
    )


def pairwise_cluster_ci(
    df: DataFrame, cluster: str = "task_id", n_bootstrap: int = 1000, seed: int = 42, value: str = "metric_value"
) -> DataFrame:
    """Per model pair: difference and interval from the same cluster draws, and whether it holds zero."""
    sums = level_sums(df, [cluster], value)
    samples = resampled_scores(sums, [cluster], n_bootstrap, seed)
    drawn = samples.groupBy("iteration").agg(F.array_sort(F.collect_list(F.struct("model", "score"))).alias("r"))
    first = drawn.select("r", F.posexplode("r").alias("i", "a"))
    both = first.select("a", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("b"))
    diffs = both.select(
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), (F.col("a.score") - F.col("b.score")).alias("d")
    )
    p = F.array(F.lit(0.025), F.lit(0.975))
    bounds = diffs.groupBy("model_a", "model_b").agg(F.percentile("d", p).alias("q"))
    means = baseline_of(sums)
    a = means.select(F.col("model").alias("model_a"), F.col("score").alias("score_a"))
    b = means.select(F.col("model").alias("model_b"), F.col("score").alias("score_b"))
    low, high = F.col("q")[0], F.col("q")[1]
    return bounds.join(a, "model_a").join(b, "model_b").select(
        "model_a", "model_b", (F.col("score_a") - F.col("score_b")).alias("difference"),
        low.alias("ci_lower"), high.alias("ci_upper"), ((low <= 0) & (high >= 0)).alias("includes_zero"),
    )
