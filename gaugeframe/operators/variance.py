"""Variance components, sequential shares, reliability and effect sizes.

Everything starts from ``gram``: counts and means per facet level and per pair of levels, taken in
one pass with grouping sets. Sums of squares, sequential effects and leave-one-out changes are then
algebra on that summary, and rows are not read again.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.order_stats import with_counts_below
from gaugeframe.operators.describe import level_moments, level_values
from gaugeframe.operators.joins import join_levels
from gaugeframe.session import cut_lineage

FACETS = ("model", "task_id", "prompt_id", "run_id", "temperature")
FLOOR = 1e-12
# Sets of facets that rows are expanded to at once. The code generated for many more is too long to be compiled by the JVM.
SETS = 16


def present_facets(df: DataFrame, facets: list[str] | None = None) -> list[str]:
    return [f for f in (facets or FACETS) if f in df.columns]


def _labels(columns: list[str], sets: list[list[str]], by: list[str], depth: int) -> list[Column]:
    """f0,l0,f1,l1,…: names and levels of each grouping set's facets, told apart by its grouping id."""
    out = []
    for i in range(depth):
        name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
        for members in sets:
            facets = [c for c in members if c not in by]
            if i < len(facets):
                gid = sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in members)
                here = F.grouping_id() == gid
                name, level = F.when(here, facets[i]).otherwise(name), F.when(here, F.col(facets[i])).otherwise(level)
        out += [name.alias(f"f{i}"), level.alias(f"l{i}")]
    return out


def level_sets(
    df: DataFrame,
    facets: list[str],
    depths: tuple[int, ...],
    by: list[str] | None = None,
    value: str = "metric_value",
) -> DataFrame:
    """Count, mean and variance for every combination of ``depths`` facets, in one shuffle.

    Each task combines its rows per level set before the shuffle, and variances are merged as centred moments, so an
    offset of all values cancels nothing. A row without a value is left out; one with a null facet is left out of
    that facet's sets only. Columns f0,l0,f1,l1,… name the facets (in the given order) and their levels.
    """
    by = by or []
    n = F.count(F.lit(1))
    moments = [n.alias("n"), F.avg("_y").alias("mean"), F.when(n > 1, F.var_samp("_y")).alias("var")]
    return _by_sets(_valued(df, [*by], facets, value), facets, depths, by, moments)


def _valued(df: DataFrame, by: list[str], facets: list[str], value: str) -> DataFrame:
    rows = df.select(*by, *[F.col(f).cast("string").alias(f) for f in facets], F.col(value).cast("double").alias("_y"))
    return rows.filter(F.col("_y").isNotNull() & ~F.isnan("_y"))


def _by_sets(rows: DataFrame, facets: list[str], depths: tuple[int, ...], by: list[str], aggregates: list[Column]) -> DataFrame:
    """The aggregates of every level set, ``SETS`` sets of facets from one reading of the rows."""
    sets = [[*by, *c] for d in depths for c in combinations(facets, d)]
    found = None
    for part in (sets[i : i + SETS] for i in range(0, len(sets), SETS)):
        stats = rows.groupingSets(part, *by, *facets).agg(*aggregates, *_labels([*by, *facets], part, by, max(depths)))
        for i in range(max(depths)):
            stats = stats.filter(F.col(f"f{i}").isNull() | F.col(f"l{i}").isNotNull())
        stats = stats.drop(*facets)
        found = stats if found is None else found.unionByName(stats)
    return found


def centred_level_sets(df: DataFrame, facets: list[str], depths: tuple[int, ...], value: str = "metric_value") -> DataFrame:
    """``level_sets`` with means taken from the grand mean, for many depths.

    Rows are read once, for the moments of each observed combination of all facets; these are written, and level sets add them up.
    Squares are taken from the grand mean, so an offset of all values cancels nothing.
    """
    n = F.count(F.lit(1))
    cells = _valued(df, [], facets, value).groupBy(*facets).agg(
        n.alias("_n"), F.avg("_y").alias("_a"), (F.var_pop("_y") * n).alias("_q")
    )
    cells = cut_lineage(cells)
    grand = cells.agg((F.sum(F.col("_n") * F.col("_a")) / F.sum("_n")).alias("_m"))
    shifted = cells.join(F.broadcast(grand)).select(*facets, "_n", (F.col("_a") - F.col("_m")).alias("_a"), "_q")
    total, first = F.sum("_n"), F.sum(F.col("_n") * F.col("_a"))
    square = F.sum(F.col("_q") + F.col("_n") * F.col("_a") * F.col("_a"))
    sums = _by_sets(shifted, facets, depths, [], [total.alias("n"), (first / total).alias("mean"), square.alias("_s")])
    var = F.greatest((F.col("_s") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1), F.lit(0.0))
    return sums.withColumn("var", F.when(F.col("n") > 1, var)).drop("_s")


def gram(
    df: DataFrame,
    facets: list[str] | None = None,
    by: list[str] | None = None,
    value: str = "metric_value",
) -> DataFrame:
    """The facet summary (total, levels, pairs of levels), written once and reused."""
    return cut_lineage(level_sets(df, present_facets(df, facets), (0, 1, 2), by, value))


def _split(g: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    total = g.filter("f0 IS NULL").select(
        *by, F.col("n").alias("n_all"), F.col("mean").alias("grand"), F.col("var").alias("total")
    )
    levels = g.filter("f0 IS NOT NULL AND f1 IS NULL").select(
        *by, F.col("f0").alias("facet"), F.col("l0").alias("level"), "n", "mean"
    )
    pairs = g.filter("f1 IS NOT NULL").select(*by, "f0", "l0", "f1", "l1", "n")
    return total, levels, pairs


def _with_total(df: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    # ``total`` has one row per stratum; without strata it is a single row
    return df.join(total, by) if by else df.join(F.broadcast(total))


def variance_components(
    df: DataFrame,
    facets: list[str] | None = None,
    by: list[str] | None = None,
    value: str = "metric_value",
    summary: DataFrame | None = None,
) -> DataFrame:
    """Per facet the sample variance of (level mean - grand mean) over rows; residual and total.

    The residual is var(y - m - sum of effects), computed from the cross terms of level pairs.
    Rows: (by…, component, variance, n).
    """
    by = by or []
    g = summary if summary is not None else gram(df, facets, by, value)
    total, levels, pairs = _split(g, by)
    effects = _with_total(levels, total, by).withColumn("d", F.col("mean") - F.col("grand"))
    ss = effects.groupBy(*by, "facet").agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ss"))
    left = effects.select(*by, F.col("facet").alias("f0"), F.col("level").alias("l0"), F.col("d").alias("d0"))
    right = effects.select(*by, F.col("facet").alias("f1"), F.col("level").alias("l1"), F.col("d").alias("d1"))
    cross = (
        pairs.join(left, [*by, "f0", "l0"])
        .join(right, [*by, "f1", "l1"])
        .groupBy(*by)
        .agg(F.sum(F.col("n") * F.col("d0") * F.col("d1")).alias("cross"))
    )
    freedom = F.greatest(F.col("n_all") - 1, F.lit(1))
    per_facet = _with_total(ss, total, by).select(
        *by, F.col("facet").alias("component"), (F.col("ss") / freedom).alias("variance"), F.col("n_all").alias("n")
    )
    explained = ss.groupBy(*by).agg(F.sum("ss").alias("explained"))
    whole = _with_total(explained, total, by)
    whole = whole.join(cross, by, "left") if by else whole.join(F.broadcast(cross))
    all_var = F.coalesce(F.col("total"), F.lit(0.0))
    residual = F.greatest(
        all_var + (2 * F.coalesce(F.col("cross"), F.lit(0.0)) - F.col("explained")) / freedom, F.lit(0.0)
    )
    rest = whole.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit("residual").alias("component"), residual.alias("variance")),
                F.struct(F.lit("total").alias("component"), all_var.alias("variance")),
            )
        ).alias("r"),
        F.col("n_all").alias("n"),
    ).select(*by, "r.component", "r.variance", "n")
    return per_facet.unionByName(rest)


def variance_table(df: DataFrame, facets: list[str] | None = None, value: str = "metric_value") -> DataFrame:
    """Components as rows with their percentage of the total, largest first."""
    components = variance_components(df, facets, value=value)
    total = components.filter("component = 'total'").select(
        F.greatest(F.col("variance"), F.lit(FLOOR)).alias("_total")
    )
    return (
        components.filter("component <> 'total'")
        .join(F.broadcast(total))
        .select("component", "variance", (100.0 * F.col("variance") / F.col("_total")).alias("pct_total_variance"))
        .orderBy(F.desc("variance"), "component")
    )


def g_study(df: DataFrame, facets: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Variance components with the facet list, per stratum when ``by`` is given."""
    names = present_facets(df, facets)
    return variance_components(df, names, by).withColumn("facets", F.lit(",".join(names)))


def _wide_components(df: DataFrame, facets: list[str], by: list[str]) -> DataFrame:
    long = variance_components(df, facets, by)
    keys = [*facets, "residual", "total"]
    picks = [
        F.coalesce(F.max(F.when(F.col("component") == k, F.col("variance"))), F.lit(0.0)).alias(f"v_{k}")
        for k in keys
    ]
    return long.groupBy(*by).agg(F.max("n").alias("n_observations"), *picks)


def design_grid(
    df: DataFrame, task_counts: list[int], prompt_counts: list[int], run_counts: list[int]
) -> DataFrame:
    """Attach every (n_tasks, n_prompts, n_runs) combination to each row of a summary."""
    out = df
    for name, counts in (("n_tasks", task_counts), ("n_prompts", prompt_counts), ("n_runs", run_counts)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(c) for c in counts])))
    return out


def d_study(
    df: DataFrame,
    task_counts: list[int],
    prompt_counts: list[int],
    run_counts: list[int],
    by: list[str] | None = None,
    universe: list[str] | None = None,
) -> DataFrame:
    """G, Phi and expected observed variance of each proposed design, per stratum.

    ``g_coefficient`` ignores the replication counts, as the published estimator does. ``g_rel``
    and ``phi_abs`` divide by the counts and are the ones to act on.
    """
    by = by or []
    facets = present_facets(df)
    wide = design_grid(_wide_components(df, facets, by), task_counts, prompt_counts, run_counts)
    counts = {"task_id": "n_tasks", "prompt_id": "n_prompts", "run_id": "n_runs"}
    universe = universe or list(counts)
    var = {f: F.col(f"v_{f}") for f in facets}
    residual = F.col("v_residual")
    target = sum((var[f] for f in universe if f in var), F.lit(0.0))
    phi_error, observed, absolute = residual, residual, F.lit(0.0)
    for facet, n in counts.items():
        if facet not in var:
            continue
        scaled = F.when(F.col(n) > 0, var[facet] / F.col(n)).otherwise(0.0)
        observed = observed + scaled
        absolute = absolute + scaled
        if facet in universe:
            phi_error = phi_error + F.when(F.col(n) > 1, var[facet] / F.col(n)).otherwise(0.0)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    model = var.get("model", F.lit(0.0))
    replicated = residual / (F.col("n_tasks") * F.col("n_prompts") * F.col("n_runs"))
    return wide.select(
        *by,
        "n_tasks",
        "n_prompts",
        "n_runs",
        ratio(target, target + residual).alias("g_coefficient"),
        ratio(target, target + phi_error).alias("phi_coefficient"),
        F.greatest(observed, F.lit(0.0)).alias("expected_observed_variance"),
        ratio(model, model + replicated).alias("g_rel"),
        ratio(model, model + absolute + replicated).alias("phi_abs"),
    )


def type1_orderings(
    df: DataFrame, orders: list[list[str]], value: str = "metric_value", summary: DataFrame | None = None
) -> DataFrame:
    """Sequential sums of squares under several facet orders.

    Each step takes level means of the running residual. They follow from level means and pair
    counts: e_k(l) = mean_l - m - sum over earlier facets of the average earlier effect in l. All
    orders advance together, one step at a time; the small effect table is written after each step.
    """
    facets = sorted({f for o in orders for f in o}, key=list(FACETS).index)
    g = summary if summary is not None else gram(df, facets, value=value)
    total, levels, pairs = _split(g, [])
    base = levels.join(F.broadcast(total)).select(
        "facet", "level", "n", (F.col("mean") - F.col("grand")).alias("d")
    )
    both = pairs.select(
        F.col("f0").alias("facet"), F.col("l0").alias("level"), F.col("f1").alias("other"), F.col("l1").alias("other_level"), "n"
    ).unionByName(
        pairs.select(
            F.col("f1").alias("facet"), F.col("l1").alias("level"), F.col("f0").alias("other"), F.col("l0").alias("other_level"), "n"
        )
    )
    spark = df.sparkSession
    labels = [",".join(o) for o in orders]
    effects: DataFrame | None = None
    for step in range(max(len(o) for o in orders)):
        now = spark.createDataFrame(
            [(labels[i], o[step]) for i, o in enumerate(orders) if step < len(o)], "facet_order string, facet string"
        )
        raw = base.join(F.broadcast(now), "facet")
        if effects is None:
            fresh = raw.withColumn("e", F.col("d"))
        else:
            earlier = effects.select(
                "facet_order", F.col("facet").alias("other"), F.col("level").alias("other_level"), F.col("e").alias("prior")
            )
            carried = (
                both.join(F.broadcast(now), "facet")
                .join(earlier, ["facet_order", "other", "other_level"])
                .groupBy("facet_order", "facet", "level")
                .agg(F.sum(F.col("n") * F.col("prior")).alias("carried"))
            )
            fresh = raw.join(carried, ["facet_order", "facet", "level"], "left").withColumn(
                "e", F.col("d") - F.coalesce(F.col("carried"), F.lit(0.0)) / F.col("n")
            )
        fresh = fresh.select("facet_order", "facet", "level", "n", "e", F.lit(step + 1).alias("step"))
        effects = cut_lineage(fresh if effects is None else effects.unionByName(fresh))
    ss_total = F.col("total") * (F.col("n_all") - 1)
    shares = effects.groupBy("facet_order", "step", "facet").agg(
        F.sum(F.col("n") * F.col("e") * F.col("e")).alias("ss")
    )
    rest = shares.groupBy("facet_order").agg(F.max("step").alias("step"), F.sum("ss").alias("ss"))
    rest = rest.join(F.broadcast(total)).select(
        "facet_order",
        (F.col("step") + 1).alias("step"),
        F.lit("residual").alias("facet"),
        (ss_total - F.col("ss")).alias("ss"),
    )
    return shares.unionByName(rest).join(F.broadcast(total)).select(
        "facet_order",
        "step",
        F.col("facet").alias("component"),
        F.col("ss"),
        F.when(ss_total > 0, 100.0 * F.col("ss") / ss_total).otherwise(0.0).alias("pct_ss"),
    )


def type1_shares(df: DataFrame, order: list[str] | None = None, value: str = "metric_value") -> DataFrame:
    """Sequential sums of squares for one facet order."""
    return type1_orderings(df, [order or present_facets(df)], value).drop("facet_order")


def sequential_residuals(df: DataFrame, facets: list[str] | None = None, value: str = "metric_value") -> DataFrame:
    """Add ``residual`` = y - m - sum of (level mean - m) to every row."""
    names = present_facets(df, facets)
    summary = cut_lineage(level_sets(df, names, (0, 1), value=value))
    # one row: the grand mean
    grand = summary.filter("f0 IS NULL").select(F.col("mean").alias("_m"))
    out = df.join(F.broadcast(grand)).withColumn("residual", F.col(value) - F.col("_m"))
    for f in names:
        effect = summary.filter(F.col("f0") == f).select(F.col("l0").alias("_level"), F.col("mean").alias("_lm"))
        out = join_levels(out.withColumn("_level", F.col(f).cast("string")), effect, ["_level"])
        out = out.withColumn("residual", F.col("residual") - (F.col("_lm") - F.col("_m"))).drop("_level", "_lm")
    return out.drop("_m")


def interaction_shares(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Percent of SS for model, task, model x task and within-cell residual."""
    names = ["model", "task_id"]
    g = level_sets(df, names, (0, 1, 2), value=value)
    kind = (
        F.when(F.col("f0").isNull(), "total")
        .when(F.col("f1").isNotNull(), "cell")
        .otherwise(F.col("f0"))
    )
    # SS between groups = sum n*(mean - m)^2, so one more aggregate over the summary is enough
    g = cut_lineage(g)
    grand = g.filter("f0 IS NULL").select(F.col("mean").alias("_m"))  # one row
    g = g.join(F.broadcast(grand)).withColumn("mean", F.col("mean") - F.col("_m"))
    by_kind = g.groupBy(kind.alias("kind")).agg(
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"),
        F.max("n").alias("n"),
        F.max("var").alias("var"),
    )

    def pick(k: str, col: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.col(col)))

    one = by_kind.agg(
        pick("total", "q").alias("q0"),
        pick("model", "q").alias("qm"),
        pick("task_id", "q").alias("qt"),
        pick("cell", "q").alias("qc"),
        (pick("total", "var") * (pick("total", "n") - 1)).alias("sst"),
    )
    ss_m, ss_t, ss_c = F.col("qm") - F.col("q0"), F.col("qt") - F.col("q0"), F.col("qc") - F.col("q0")
    terms = {
        "model": ss_m,
        "task": ss_t,
        "model_x_task": ss_c - ss_m - ss_t,
        "residual": F.col("sst") - ss_c,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), v.alias("ss")) for k, v in terms.items()]))
    return one.select("sst", rows.alias("r")).select(
        "r.component", "r.ss", (100.0 * F.col("r.ss") / F.col("sst")).alias("pct_ss")
    )


def _extremes(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per factor the moments of the highest-mean and lowest-mean level (ties by level name)."""
    stats = F.struct("level", "n", "mean", "var")
    # struct comparison is left to right, so the second field breaks ties of the rounded mean
    key = F.struct(F.round("mean", 12), F.col("level"))
    return moments.groupBy(*(by or []), "factor").agg(
        F.max_by(stats, key).alias("hi"), F.min_by(stats, key).alias("lo"), F.count(F.lit(1)).alias("levels")
    )


def cohens_d(
    df: DataFrame, factors: list[str], value: str = "metric_value", by: list[str] | None = None,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Highest-mean level minus lowest-mean level over the pooled SD, per factor."""
    moments = level_moments(df, factors, value, by) if moments is None else moments
    return _cohens_from(_extremes(moments, by), by)


def _cohens_from(ends: DataFrame, by: list[str] | None = None) -> DataFrame:
    n1, n0 = F.col("hi.n"), F.col("lo.n")
    pooled = F.sqrt(((n1 - 1) * F.col("hi.var") + (n0 - 1) * F.col("lo.var")) / (n1 + n0 - 2))
    d = F.when(
        (n1 >= 2) & (n0 >= 2),
        F.when(pooled == 0, 0.0).otherwise((F.col("hi.mean") - F.col("lo.mean")) / pooled),
    )
    return ends.filter("levels >= 2").select(
        *(by or []), "factor", F.col("hi.level").alias("high_level"), F.col("lo.level").alias("low_level"), d.alias("cohens_d")
    )


def summary_moments(summary: DataFrame) -> DataFrame:
    """(factor, level, n, mean, var) out of ``gram``."""
    single = summary.filter("f0 IS NOT NULL AND f1 IS NULL")
    return single.select(F.col("f0").alias("factor"), F.col("l0").alias("level"), "n", "mean", "var")


def cliffs_delta(
    df: DataFrame, factors: list[str], value: str = "metric_value", moments: DataFrame | None = None
) -> DataFrame:
    """(#(low > high) - #(low < high)) / (n*m) from value histograms, never from row pairs.

    The sign is the published one (negative when the high level is larger);
    ``cliffs_delta_high_minus_low`` has the usual sign.
    """
    counts = level_values(df, factors, value)
    ends = _extremes(level_moments(df, factors, value) if moments is None else moments).filter("levels >= 2")
    sides = ends.select(
        "factor",
        F.explode(
            F.array(
                F.struct(F.col("hi.level").alias("level"), F.lit(1).alias("is_high")),
                F.struct(F.col("lo.level").alias("level"), F.lit(0).alias("is_high")),
            )
        ).alias("s"),
    ).select("factor", "s.level", "s.is_high")
    both = (
        counts.join(sides, ["factor", "level"])
        .groupBy("factor", "value")
        .agg(
            F.sum(F.when(F.col("is_high") == 1, F.col("c")).otherwise(0)).alias("h"),
            F.sum(F.when(F.col("is_high") == 0, F.col("c")).otherwise(0)).alias("w"),
        )
    )
    # for each distinct value: how many low-level rows lie below and above it
    placed = with_counts_below(both, ["factor"], "value", "w")
    sums = placed.groupBy("factor").agg(
        # products of counts leave the range of a long
        F.sum(F.col("h").cast("double") * F.col("below")).alias("low_below"),
        F.sum(F.col("h").cast("double") * (F.col("n") - F.col("below") - F.col("w"))).alias("low_above"),
        F.sum("h").alias("nh"),
        F.max("n").alias("nl"),
    )
    delta = (F.col("low_above") - F.col("low_below")) / (F.col("nh").cast("double") * F.col("nl"))
    return sums.select(
        "factor", delta.alias("cliffs_delta"), (-delta).alias("cliffs_delta_high_minus_low")
    )


def publication_effects(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Cohen's d, Cliff's delta, eta squared and the published ad-hoc omega squared per factor."""
    factors = present_facets(df)
    summary = gram(df, factors, value=value)
    components = variance_components(df, factors, value=value, summary=summary)
    total = components.filter("component = 'total'").select(F.col("variance").alias("total_var"))
    moments = summary_moments(summary)
    ends = _extremes(moments)
    d = _cohens_from(ends).join(ends.select("factor", "levels"), "factor")
    delta = cliffs_delta(df, factors, value, moments).select("factor", "cliffs_delta")
    vc, tv = F.col("variance"), F.col("total_var")
    omega = F.greatest((vc - (F.col("levels") - 1) * tv * 0.01) / (tv + tv * 0.01), F.lit(0.0))
    return (
        components.withColumnRenamed("component", "factor")
        .join(d, "factor")
        .join(delta, "factor")
        .join(F.broadcast(total))
        .select(
            "factor",
            F.concat_ws(" vs ", "high_level", "low_level").alias("contrast"),
            "cohens_d",
            "cliffs_delta",
            F.when(tv > 0, vc / tv).otherwise(0.0).alias("eta_squared"),
            omega.alias("omega_squared_pub"),
            vc.alias("variance_component"),
        )
    )


def prompt_effect(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Population SD of the prompt means."""
    means = df.filter("prompt_id IS NOT NULL").groupBy("prompt_id").agg(F.avg(value).alias("m"))
    return means.agg(F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("prompt_effect_std"))


# Accepted names of the columns of a pass/fail frame.
PASS_FAIL_ALIASES = {
    "model_id": ("model_id", "model"),
    "prompt_variant_id": ("prompt_variant_id", "prompt_id"),
    "task_id": ("task_id", "task"),
    "run_index": ("run_index", "run_id"),
    "temperature": ("temperature",),
}


def pass_fail_frame(df: DataFrame, metric: str = "pass_at_1") -> DataFrame:
    """Binary outcome (value >= 0.5) with the canonical design columns; all five are required.

    A row without a value did not pass and counts as 0. Rows of another metric are left out where ``metric_name`` says so.
    """
    chosen, missing = [], []
    for name, options in PASS_FAIL_ALIASES.items():
        source = next((o for o in options if o in df.columns), None)
        if source is None:
            missing.append(name)
        else:
            chosen.append((name, source))
    if missing:
        raise ValueError(f"pass/fail frame needs columns {missing}")
    outcome = next((c for c in (metric, "metric_value", "score") if c in df.columns), None)
    if outcome is None:
        raise ValueError(f"no outcome column: {metric}, metric_value or score")
    kinds = {"run_index": "int", "temperature": "double"}
    rows = df.filter(F.col("metric_name") == metric) if outcome == "metric_value" and "metric_name" in df.columns else df
    return rows.select(
        *[F.col(s).cast(kinds.get(n, "string")).alias(n) for n, s in chosen],
        F.coalesce((F.col(outcome) >= 0.5).cast("int"), F.lit(0)).alias("pass_fail"),
    )


def first_non_binary(df: DataFrame, outcome: str) -> DataFrame:
    """Rows whose outcome is neither 0 nor 1 (empty when the outcome is valid)."""
    return df.filter(F.col(outcome).isNotNull() & ~F.col(outcome).cast("double").isin(0.0, 1.0))
