"""ANOVA, binomial regression, mixed model and power.

Spark reduces the rows to sums per level, per pair of levels and per task; only matrices of the
size of the coefficient vector reach the driver. The facet with most levels (usually tasks) is
eliminated from the normal equations on Spark, so its levels never do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import tails
from gaugeframe.functions.tail_columns import f_tail
from gaugeframe.operators import least_squares
from gaugeframe.operators.variance import (
    cliffs_delta,
    cohens_d,
    design_grid,
    gram,
    present_facets,
    summary_moments,
    variance_components,
)
from gaugeframe.session import cut_lineage

# the tail functions travel to the workers with the functions that use them
cloudpickle.register_pickle_by_value(tails)

# coefficients solved on the driver (a 5000 x 5000 matrix is 200 MB)
MAX_COEFFICIENTS = 5000


def summed_products(rows: DataFrame, size: int, scales: list[float] | None = None) -> dict[tuple[str, int], np.ndarray]:
    """Sum of weight * x x' per (key, scale index) from rows (key string, x array<double>, w double).

    With ``scales`` (values of a variance ratio r) the weight becomes r / (1 + r w), and the sum of
    log(1 + r w) is kept in the last cell of one more row and column. Batches are summed inside the
    tasks, partial matrices on Spark; only the final size x size sums are collected.
    """
    if size > MAX_COEFFICIENTS:
        raise ValueError(f"{size} coefficients are more than the {MAX_COEFFICIENTS} solved on the driver")
    steps = scales

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby("key", sort=False):
                x = np.vstack(part["x"].to_numpy())
                w = part["w"].to_numpy(dtype=float)
                for s, r in enumerate(steps or [None]):
                    weight = w if r is None else r / (1.0 + r * w)
                    m = np.zeros((size + 1, size + 1))
                    m[:size, :size] = x.T @ (x * weight[:, None])
                    if r is not None:
                        m[size, size] = np.log1p(r * w).sum()
                    k = (key, s)
                    sums[k] = sums[k] + m if k in sums else m
        out = []
        for (key, s), m in sums.items():
            i, j = np.nonzero(m)
            out.append(pd.DataFrame({"key": key, "s": s, "i": i, "j": j, "v": m[i, j]}))
        if out:
            yield pd.concat(out)

    parts = rows.select("key", "x", "w").mapInPandas(partial, "key string, s int, i int, j int, v double")
    total = parts.groupBy("key", "s", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    matrices: dict[tuple[str, int], np.ndarray] = {}
    for (key, s), part in total.groupby(["key", "s"]):
        m = np.zeros((size + 1, size + 1))
        m[part["i"], part["j"]] = part["v"]
        matrices[(key, int(s))] = m
    return matrices


def _level_order(levels: list[str]) -> list[str]:
    try:
        return sorted(levels, key=float)
    except ValueError:
        return sorted(levels)


def _used_facets(df: DataFrame, g: DataFrame, key: Column) -> tuple[list[str], dict[str, int]]:
    """Facets with two levels at least, and the numbers of levels."""
    single = g.filter("f0 IS NOT NULL AND f1 IS NULL").select(key, F.col("f0").alias("f"), F.col("l0").alias("l"))
    sizes = {r.f: r.k for r in single.groupBy("f").agg(F.countDistinct("l").alias("k")).collect()}
    return [f for f in present_facets(df) if sizes.get(f, 0) > 1], sizes


def _anova_inputs(df: DataFrame, g: DataFrame, key: Column, used: list[str], sizes: dict[str, int]):
    """Per stratum: counts and sums of the small facets, raw and with the largest facet eliminated."""
    single = g.filter("f0 IS NOT NULL AND f1 IS NULL").select(key, F.col("f0").alias("f"), F.col("l0").alias("l"), "n", "mean", "var")
    largest = max(used, key=lambda f: sizes[f])
    small = [f for f in used if f != largest]
    level_rows = single.filter(F.col("f").isin(*small)).toPandas() if small else pd.DataFrame(columns=["key", "f", "l", "n", "mean"])
    columns = [(f, l) for f in small for l in _level_order(level_rows.loc[level_rows.f == f, "l"].unique().tolist())]
    total = g.filter("f0 IS NULL").select(key, "n", "mean", "var").toPandas().set_index("key")
    # sum of squares of the largest facet alone, and its first level
    big = single.filter(F.col("f") == largest)
    big_ss = big.groupBy("key").agg(
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.count(F.lit(1)).alias("k"), F.min(F.struct("l", "n", "mean")).alias("first")
    ).toPandas().set_index("key")
    size = len(columns)
    counts: dict[str, np.ndarray] = {}
    sums: dict[str, np.ndarray] = {}
    index = {c: i for i, c in enumerate(columns)}
    for k in total.index:
        counts[k] = np.zeros((size, size))
        sums[k] = np.zeros(size)
    for r in level_rows.itertuples():
        i = index[(r.f, r.l)]
        counts[r.key][i, i] = r.n
        sums[r.key][i] = r.n * r.mean
    pair = g.filter("f1 IS NOT NULL").select(key, "f0", "l0", "f1", "l1", "n")
    if small:
        for r in pair.filter(F.col("f0").isin(*small) & F.col("f1").isin(*small)).toPandas().itertuples():
            i, j = index[(r.f0, r.l0)], index[(r.f1, r.l1)]
            counts[r.key][i, j] = counts[r.key][j, i] = r.n
    eliminated, base_rows = {}, {}
    if small:
        spark = df.sparkSession
        lookup = spark.createDataFrame([(f, l, i) for (f, l), i in index.items()], "f string, l string, pos int")
        t_first = F.col("f0") == largest
        crossed = pair.filter(t_first | (F.col("f1") == largest)).select(
            "key", F.when(t_first, F.col("l0")).otherwise(F.col("l1")).alias("t"),
            F.when(t_first, F.col("f1")).otherwise(F.col("f0")).alias("f"), F.when(t_first, F.col("l1")).otherwise(F.col("l0")).alias("l"), "n",
        )
        # one vector per level of the largest facet: counts by small level, then that level's sum
        entry = F.map_from_entries(F.collect_list(F.struct("pos", F.col("n").cast("double"))))
        vectors = crossed.join(F.broadcast(lookup), ["f", "l"]).groupBy("key", "t").agg(entry.alias("e"))
        vectors = vectors.join(big.select("key", F.col("l").alias("t"), F.col("n").alias("n_t"), "mean"), ["key", "t"])
        dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.col("e")[p], F.lit(0.0)))
        x = F.concat(dense, F.array(F.col("n_t") * F.col("mean")))
        vectors = vectors.select("key", "t", x.alias("x"), (1.0 / F.col("n_t")).alias("w"))
        eliminated = summed_products(vectors, size + 1)
        firsts = {k: r["first"]["l"] for k, r in big_ss.iterrows()}
        wanted = spark.createDataFrame(list(firsts.items()), "key string, t string")
        for r in vectors.join(F.broadcast(wanted), ["key", "t"]).collect():
            base_rows[r.key] = np.asarray(r.x[:-1])
    return largest, small, columns, total, big_ss, counts, sums, eliminated, base_rows


def _explained(a: np.ndarray, b: np.ndarray, keep: list[int]) -> tuple[float, int, np.ndarray]:
    """b' A^+ b, the rank and A^+ on the kept columns."""
    if not keep:
        return 0.0, 0, np.zeros((0, 0))
    sub = a[np.ix_(keep, keep)]
    values, vectors = np.linalg.eigh((sub + sub.T) / 2.0)
    good = values > max(values.max(), 1.0) * 1e-10
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
    return float(b[keep] @ inverse @ b[keep]), int(good.sum()), inverse


ANOVA_SCHEMA = (
    "stratum string, term string, method string, sum_sq double, df double, f_stat double, p_value double, "
    "partial_eta_squared double, omega_squared double, is_intercept boolean"
)


def anova(
    df: DataFrame, anova_type: int = 2, by: str | None = None, value: str = "metric_value", summary: DataFrame | None = None
) -> DataFrame:
    """Type II or III table of the main-effects model, per stratum.

    Factors with one level are left out; without any the table is empty. For main effects the factor
    rows of both types agree; type III adds the intercept (first level of every factor), which also
    enters the total that omega squared is taken from.
    """
    spark = df.sparkSession
    g = gram(df, present_facets(df), [by] if by else [], value) if summary is None else summary
    stratum = (F.col(by).cast("string") if by else F.lit("all")).alias("key")
    used, sizes = _used_facets(df, g, stratum)
    if not used:
        return spark.createDataFrame([], ANOVA_SCHEMA)
    if sum(sizes[f] for f in used) - max(sizes[f] for f in used) > MAX_COEFFICIENTS:
        return _with_p_values(spark.createDataFrame(_anova_by_gradients(g, stratum, used, sizes, anova_type), ANOVA_SCHEMA))
    largest, small, columns, total, big_ss, counts, sums, eliminated, base_rows = _anova_inputs(df, g, stratum, used, sizes)
    size = len(columns)
    out = []
    for key, t in total.iterrows():
        n, m = float(t["n"]), float(t["mean"])
        sst = float(t["var"]) * (n - 1) if n > 1 else 0.0
        center = n * m * m
        q_big, k_big = float(big_ss.loc[key, "q"]), int(big_ss.loc[key, "k"])
        sum_y = sums[key]
        if size:
            e = eliminated[(key, 0)]
            a = counts[key] - e[:size, :size]
            b = sum_y - e[:size, size]
        else:
            a, b = np.zeros((0, 0)), np.zeros(0)
        whole = list(range(size))
        extra, rank, inverse = _explained(a, b, whole)
        sse = sst - (q_big - center) - extra
        df_error = n - k_big - rank
        rows = []
        for f in used:
            if f == largest:
                raw, raw_rank, _ = _explained(counts[key], sum_y, whole)
                ss = (q_big - center) + extra - (raw - center if size else 0.0)
                df_f = k_big + rank - (raw_rank if size else 1)
            else:
                keep = [i for i in whole if columns[i][0] != f]
                part, part_rank, _ = _explained(a, b, keep)
                ss, df_f = extra - part, rank - part_rank
            if df_f > 0:
                rows.append((f, ss, df_f, False))
        if anova_type == 3:
            first = big_ss.loc[key, "first"]
            c = np.zeros(size)
            for f in small:
                levels = [i for i in whole if columns[i][0] == f and counts[key][i, i] > 0]
                if levels:
                    c[levels[0]] = 1.0
            gap = c - (base_rows[key] / first["n"] if size else 0.0)
            estimate = first["mean"] + (float(gap @ inverse @ b) if size else 0.0)
            scale = 1.0 / first["n"] + (float(gap @ inverse @ gap) if size else 0.0)
            rows.insert(0, ("Intercept", estimate * estimate / scale, 1, True))
        out += _anova_rows(key, rows, sse, df_error, anova_type)
    return _with_p_values(spark.createDataFrame(out, ANOVA_SCHEMA))


def _with_p_values(rows: DataFrame) -> DataFrame:
    """P(F > f) in place of the degrees of freedom of the error that the rows bring in `p_value`."""
    return rows.withColumn("p_value", f_tail(F.col("f_stat"), F.col("df"), F.col("p_value")))


def _anova_rows(key: str, rows: list[tuple], sse: float, df_error: float, anova_type: int) -> list[tuple]:
    """Table rows of a stratum from (term, sum of squares, df, is the intercept), with the error's degrees of freedom for `p_value`."""
    out = []
    mse = sse / df_error if df_error > 0 else 0.0
    table_total = sum(r[1] for r in rows) + sse
    for term, ss, df_f, intercept in rows:
        usable = mse > 0 and df_error > 0
        f_stat = ss / df_f / mse if usable else None
        eta = ss / (ss + sse) if ss + sse > 0 else 0.0
        omega = max((ss - df_f * mse) / (table_total + mse), 0.0) if table_total + mse > 0 else 0.0
        out.append((str(key), term, f"anova_type_{anova_type}", float(ss), float(df_f), f_stat, float(df_error) if usable else None, float(eta), float(omega), intercept))
    return out


def _anova_by_gradients(g: DataFrame, stratum: Column, used: list[str], sizes: dict[str, int], anova_type: int) -> list[tuple]:
    """The table where facets have too many levels for a matrix: every model, with all facets and without each, by conjugate gradients."""
    total = {r.key: r for r in g.filter("f0 IS NULL").select(stratum, "n", "mean", "var").collect()}
    centre = g.filter("f0 IS NULL").select(stratum, F.col("mean").alias("grand"))
    single = g.filter(F.col("f0").isin(*used) & F.col("f1").isNull()).select(stratum, F.col("f0").alias("f"), F.col("l0").alias("l"), "n", "mean")
    levels = single.join(F.broadcast(centre), "key").withColumn("b", F.col("n") * (F.col("mean") - F.col("grand")))
    wanted = None
    if anova_type == 3:
        # the first level of each facet: by number where all levels are numbers, but as text in the facet with most levels
        largest = max(used, key=lambda f: sizes[f])
        number = F.expr("try_cast(l AS double)")
        textual = levels.groupBy("f").agg(F.bool_or(number.isNull()).alias("_textual"))
        order = F.when(F.col("_textual") | (F.col("f") == largest), F.struct(F.lit(0.0).alias("a"), F.col("l").alias("b"))).otherwise(F.struct(number.alias("a"), F.col("l").alias("b")))
        firsts = levels.join(F.broadcast(textual), "f").groupBy("key", "f").agg(F.min_by("l", order).alias("l")).withColumn("_first", F.lit(True))
        levels = levels.join(F.broadcast(firsts), ["key", "f", "l"], "left")
        wanted = F.coalesce("_first", F.lit(False))
    pairs = g.filter(F.col("f0").isin(*used) & F.col("f1").isin(*used)).select(stratum, "f0", "l0", "f1", "l1", "n")
    ordered = sorted(used, key=lambda f: -sizes[f])
    sets = [ordered, *[[o for o in ordered if o != f] for f in used]]
    found = least_squares.fits(cut_lineage(levels), pairs, sets, wanted)
    out = []
    for key, t in total.items():
        whole = found[(key, 0)]
        sst = float(t["var"]) * (t["n"] - 1) if t["n"] > 1 else 0.0
        sse, df_error = sst - whole.explained, t["n"] - whole.rank
        rows = [(f, whole.explained - found[(key, i + 1)].explained, whole.rank - found[(key, i + 1)].rank, False) for i, f in enumerate(used)]
        rows = [r for r in rows if r[2] > 0]
        if anova_type == 3:
            rows.insert(0, ("Intercept", (t["mean"] + whole.estimate) ** 2 / whole.scale, 1, True))
        out += _anova_rows(key, rows, sse, df_error, anova_type)
    return out


def max_partial_eta(df: DataFrame, by: str, value: str = "metric_value") -> DataFrame:
    """Largest type II partial eta squared per stratum."""
    return anova(df, 2, by, value).groupBy("stratum").agg(F.max("partial_eta_squared").alias("max_partial_eta_squared_type2"))


def factor_effect_sizes(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Cohen's d, Cliff's delta and the type II effect sizes per factor with at least two levels."""
    facets = present_facets(df)
    summary = gram(df, facets, value=value)
    moments = summary_moments(summary)
    d = cohens_d(df, facets, value, moments=moments).select("factor", "cohens_d")
    delta = cliffs_delta(df, facets, value, moments)
    table = anova(df, 2, value=value, summary=summary).select(
        F.col("term").alias("factor"), "partial_eta_squared", "omega_squared", F.col("p_value").alias("p_value_type2")
    )
    return d.join(delta, "factor").join(table, "factor", "left")


# ---- binomial regression ----


DESIGN = ("model_id", "prompt_variant_id", "temperature")


def outcome_cells(frame: DataFrame, cluster: str = "task_id") -> DataFrame:
    """Counts and successes per model, prompt, temperature and cluster: the only pass over the rows."""
    return cut_lineage(
        frame.groupBy(*DESIGN, cluster).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("pass_fail").cast("double").alias("k")
        )
    )


def outcome_table(cells: DataFrame) -> DataFrame:
    """Counts and successes per model, prompt and temperature."""
    return cells.groupBy(*DESIGN).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def separated_levels(cells: DataFrame) -> DataFrame:
    """Levels whose outcomes are all 0 or all 1: their coefficients do not exist."""
    parts = F.explode(
        F.array(
            F.struct(F.lit("model_id").alias("factor"), F.col("model_id").alias("level")),
            F.struct(F.lit("prompt_variant_id").alias("factor"), F.col("prompt_variant_id").alias("level")),
        )
    )
    sums = outcome_table(cells).select(parts.alias("p"), "n", "k").groupBy("p.factor", "p.level").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return sums.filter("k = 0 OR k = n")


COEFFICIENT_SCHEMA = (
    "term string, log_odds_estimate double, std_error double, z double, p_value double, odds_ratio double, "
    "or_ci_lower double, or_ci_upper double, finite boolean, include_in_publication boolean, method string"
)


class BinomialFit:
    """Coefficients of a logit fit with its design, for reuse by the cluster-robust errors."""

    def __init__(self, terms, columns, estimates, errors, separated, cells):
        self.terms, self.columns, self.estimates, self.errors = terms, columns, estimates, errors
        self.separated, self.cells = separated, cells

    def coefficients(self, spark: SparkSession, errors=None, method: str = "binomial_glm") -> DataFrame:
        errors = self.errors if errors is None else errors
        rows = []
        for term, b, se in zip(self.terms, map(float, self.estimates), map(float, errors), strict=True):
            finite = math.isfinite(b) and math.isfinite(se) and se > 0
            z = b / se if finite else None
            p = float(2 * tails.normal_sf(abs(z))) if finite else None

            def odds(x: float) -> float | None:
                return math.exp(x) if math.isfinite(x) and abs(x) < 700 else None

            rows.append(
                (term, b, se, z, p, odds(b), odds(b - 1.96 * se), odds(b + 1.96 * se), finite, finite and not self.separated, method)
            )
        return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def binomial_glm(frame: DataFrame, cluster: str = "task_id") -> BinomialFit:
    """Logit of pass_fail on model, prompt and temperature, fitted on the count table.

    Label is the share of successes, weight the count: the same likelihood as row by row. Base levels
    are the alphabetically first ones; a factor with one level is left out.
    """
    cells = outcome_cells(frame, cluster)
    counts = outcome_table(cells)
    levels = counts.agg(
        *[F.sort_array(F.collect_set(c)).alias(c) for c in ("model_id", "prompt_variant_id")], F.countDistinct("temperature").alias("t")
    ).first()
    factors = [c for c in ("model_id", "prompt_variant_id") if len(levels[c]) > 1]
    linear = ["temperature"] if levels["t"] > 1 else []
    columns = [(f, l) for f in factors for l in levels[f][1:]] + [(c, None) for c in linear]
    if len(columns) + 1 > MAX_COEFFICIENTS:
        raise ValueError("too many model and prompt levels for one fit")
    if not columns:
        raise ValueError("binomial fit needs a factor with two levels")
    data = counts.withColumn("share", F.col("k") / F.col("n"))
    formula = RFormula(
        formula="share ~ " + " + ".join([*factors, *linear]), stringIndexerOrderType="alphabetDesc", featuresCol="x", labelCol="y"
    )
    encoded = formula.fit(data).transform(data).select("x", "y", "n")
    fit = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="n", featuresCol="x", labelCol="y", maxIter=100, tol=1e-10
    ).fit(encoded)
    errors = fit.summary.coefficientStandardErrors
    # the formula encodes levels in reverse order and drops the first one; names come from its metadata
    names = encoded.schema["x"].metadata["ml_attr"]["attrs"]
    order = [a["name"] for kind in names.values() for a in sorted(kind, key=lambda a: a["idx"])]
    position = {name: i for kind in names.values() for name, i in ((a["name"], a["idx"]) for a in kind)}
    labels = [f"{f}_{l}" if l is not None else f for f, l in columns]
    if sorted(labels) != sorted(order):
        raise RuntimeError(f"unexpected design columns: {order}")
    estimates = np.array([fit.intercept, *[fit.coefficients[position[x]] for x in labels]])
    std = np.array([errors[-1], *[errors[position[x]] for x in labels]])
    separated = separated_levels(cells).limit(1).count() > 0
    return BinomialFit(["const", *labels], columns, estimates, std, separated, cells)


def _design(columns: list) -> Column:
    entries = [F.lit(1.0)]
    for name, level in columns:
        entries.append(F.col(name).cast("double") if level is None else (F.col(name) == level).cast("double"))
    return F.array(*entries)


def cluster_robust_se(fit: BinomialFit, cluster: str = "task_id") -> DataFrame:
    """The fit's odds-ratio table with sandwich errors clustered by task.

    Scores are summed per cluster on Spark; the meat is the sum of their outer products. The factor
    G/(G-1) * (N-1)/(N-K) corrects for few clusters.
    """
    k = len(fit.terms)
    counts = fit.cells
    x = _design(fit.columns)
    eta = F.lit(0.0)
    for i, b in enumerate(fit.estimates):
        eta = eta + F.lit(float(b)) * F.col("x")[i]
    rows = counts.withColumn("x", x).withColumn("p", 1.0 / (1.0 + F.exp(-eta)))
    information = rows.groupBy("model_id", "prompt_variant_id", "temperature").agg(
        F.max("x").alias("x"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("w")
    )
    bread = np.linalg.pinv(summed_products(information.select(F.lit("all").alias("key"), "x", "w"), k)[("all", 0)][:k, :k])
    rest = F.col("k") - F.col("n") * F.col("p")
    scores = rows.groupBy(cluster).agg(F.array(*[F.sum(F.col("x")[i] * rest) for i in range(k)]).alias("x"))
    meat = summed_products(scores.select(F.lit("all").alias("key"), "x", F.lit(1.0).alias("w")), k)[("all", 0)][:k, :k]
    sizes = counts.agg(F.sum("n").alias("n"), F.countDistinct(cluster).alias("g")).first()
    factor = sizes.g / (sizes.g - 1) * (sizes.n - 1) / (sizes.n - k)
    errors = np.sqrt(np.diag(bread @ meat @ bread) * factor)
    return fit.coefficients(counts.sparkSession, errors, "binomial_glm_cluster_robust")


def compare_fixed_effects(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Terms of two fits side by side: same direction, interval overlap, conclusion changed."""
    keep = ["term", "odds_ratio", "or_ci_lower", "or_ci_upper"]
    a = full.select("term", *[F.col(c).alias(f"{c}_full") for c in keep[1:]])
    b = reduced.select("term", *[F.col(c).alias(f"{c}_reduced") for c in keep[1:]])
    same = F.coalesce(F.signum(F.log("odds_ratio_full")) == F.signum(F.log("odds_ratio_reduced")), F.lit(False))
    apart = (F.col("or_ci_upper_full") < F.col("or_ci_lower_reduced")) | (F.col("or_ci_upper_reduced") < F.col("or_ci_lower_full"))
    overlap = ~F.coalesce(apart, F.lit(False))
    return a.join(b, "term").select(
        "term", "odds_ratio_full", "odds_ratio_reduced", same.alias("same_direction"), overlap.alias("ci_overlap"),
        (~(same & overlap)).alias("conclusion_changed"),
    )


# ---- random intercept ----

LMM_SCHEMA = "term string, kind string, estimate double, std_err double, method string"
SMALLEST_RATIO = 1e-12
COARSE = [10.0 ** (e / 4.0) for e in range(-24, 17)]


def random_intercept_lmm(
    df: DataFrame, group: str = "task_id", fixed: tuple[str, ...] = ("model",), value: str = "metric_value"
) -> DataFrame:
    """y ~ fixed + (1 | group) by REML: fixed effects, group variance and residual variance.

    One pass makes a vector per group (row count, column sums of the design, sum of y). REML is then
    profiled over the variance ratio: each candidate needs a weighted sum of products of those
    vectors. With fewer than two groups the components of the ANOVA stand in, labelled so.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    if rows.select(group).distinct().limit(2).count() < 2:
        c = variance_components(df, value=value)
        return c.filter("component <> 'total'").select(
            F.col("component").alias("term"), F.lit("variance").alias("kind"), F.col("variance").alias("estimate"),
            F.lit(None).cast("double").alias("std_err"), F.lit("anova_fallback").alias("method"),
        )
    cells = cut_lineage(
        rows.groupBy(group, *fixed).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("sy"), F.sum(F.col(value) * F.col(value)).alias("syy")
        )
    )
    columns: list = []
    for f in fixed:
        if f == "temperature":
            columns.append((f, None))
        else:
            found = [r[0] for r in cells.select(F.col(f).cast("string")).distinct().limit(MAX_COEFFICIENTS + 1).collect()]
            columns += [(f, l) for l in _level_order(found)[1:]]
    k = len(columns) + 1
    x = _design(columns)
    xs = cells.withColumn("x", x)
    # global X'X from the distinct design rows, X'y and y'y beside it
    plain = xs.select(F.lit("all").alias("key"), F.concat("x", F.array(F.col("sy") / F.col("n"))).alias("x"), F.col("n").alias("w"))
    whole = summed_products(plain, k + 1)[("all", 0)][: k + 1, : k + 1]
    totals = cells.agg(F.sum("syy").alias("syy"), F.sum("n").alias("n")).first()
    whole[k, k] = totals.syy
    groups = cut_lineage(
        xs.groupBy(group).agg(
            F.array(*[F.sum(F.col("x")[i] * F.col("n")) for i in range(k)], F.sum("sy")).alias("x"), F.sum("n").alias("w")
        ).select(F.lit("all").alias("key"), "x", "w")
    )
    n = float(totals.n)

    def profile(ratios: list[float]):
        """(criterion, beta, residual variance, X'V^-1X) for each ratio."""
        sums = summed_products(groups, k + 1, ratios)
        fits = []
        for s in range(len(ratios)):
            m = sums[("all", s)]
            reduced = whole - m[: k + 1, : k + 1]
            a, b, q = reduced[:k, :k], reduced[:k, k], reduced[k, k]
            beta = np.linalg.solve(a, b)
            rss = q - b @ beta
            fits.append(((n - k) * math.log(rss / (n - k)) + m[k + 1, k + 1] + np.linalg.slogdet(a)[1], beta, rss / (n - k), a))
        return fits

    grid = [SMALLEST_RATIO, *COARSE]
    for _ in range(3):
        fits = profile(grid)
        at = int(np.argmin([f[0] for f in fits]))
        last = grid
        grid = list(np.exp(np.linspace(math.log(grid[max(at - 1, 0)]), math.log(grid[min(at + 1, len(grid) - 1)]), 41)))
    ratio = last[at]
    if 0 < at < len(last) - 1:
        # vertex of the parabola through the three best points on the log scale
        c0, c1, c2 = (fits[at + d][0] for d in (-1, 0, 1))
        bend = c0 - 2 * c1 + c2
        if bend > 0:
            ratio = math.exp(math.log(last[at]) + 0.5 * (c0 - c2) / bend * math.log(last[at + 1] / last[at]))
    (_, beta, sigma2, a), = profile([ratio])
    if ratio < 1e-9:
        ratio = 0.0
    errors = np.sqrt(np.diag(np.linalg.inv(a)) * sigma2)
    names = ["Intercept", *[f"{f}_{l}" if l is not None else f for f, l in columns]]
    out = [(t, "fixed", float(b), float(e), "reml_profile") for t, b, e in zip(names, beta, errors, strict=True)]
    out.append((group, "variance", float(ratio * sigma2), None, "reml_profile"))
    out.append(("residual", "variance", float(sigma2), None, "reml_profile"))
    return spark.createDataFrame(out, LMM_SCHEMA)


def method_comparison(*tables: DataFrame) -> DataFrame:
    """ANOVA and mixed-model rows in one table; a mixed model has no omega squared."""
    shaped = []
    for t in tables:
        if "sum_sq" in t.columns:
            shaped.append(t.select("term", "method", "sum_sq", "df", "f_stat", "p_value", "partial_eta_squared", "omega_squared",
                                   F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("std_err")))
        else:
            none = F.lit(None).cast("double")
            shaped.append(t.select("term", "method", *[none.alias(c) for c in ("sum_sq", "df", "f_stat", "p_value", "partial_eta_squared", "omega_squared")], "estimate", "std_err"))
    out = shaped[0]
    for t in shaped[1:]:
        out = out.unionByName(t)
    return out


# ---- power ----

# The published floors of the residual variance, in the draws and in the test.
DRAW_FLOOR, TEST_FLOOR = 0.1, 1e-6


def power_grid(
    df: DataFrame,
    effect_size: float,
    task_counts: list[int],
    prompt_counts: list[int],
    run_counts: list[int],
    alpha: float = 0.05,
    by: list[str] | None = None,
    draw_floor: float = DRAW_FLOOR,
    value: str = "metric_value",
) -> DataFrame:
    """Power to tell two models apart at each design, per stratum, in closed form.

    Task, prompt and run effects hit both models alike and cancel, so the mean difference is normal
    around the effect and is tested against its standard error. ``t_power`` is the two-sample t
    test's power for the standardised effect.
    """
    by = by or []
    components = variance_components(df, present_facets(df), by, value)
    residual = components.filter("component = 'residual'").select(*by, F.col("variance").alias("residual"))
    grid = design_grid(residual, task_counts, prompt_counts, run_counts).withColumn(
        "n_cells", F.col("n_tasks") * F.col("n_prompts") * F.col("n_runs")
    )

    def add(batches):
        for b in batches:
            n = b["n_cells"].to_numpy(dtype=float)
            res = b["residual"].to_numpy(dtype=float)
            drawn = np.sqrt(2.0 * np.maximum(res, draw_floor) / n)
            tested = np.sqrt(2.0 * np.maximum(res, TEST_FLOOR) / n)
            bar = tails.t_upper(alpha / 2.0, np.maximum(2.0 * n - 2.0, 1.0)) * tested
            power = tails.normal_sf((bar - effect_size) / drawn) + tails.normal_sf((bar + effect_size) / drawn)
            b["power"] = np.where(n < 2, 0.0, power)
            b["t_power"] = tails.noncentral_t_power(effect_size / np.sqrt(np.maximum(res, TEST_FLOOR)), n, alpha)
            yield b

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema.fields)
    return grid.mapInPandas(add, f"{spec}, power double, t_power double").withColumns(
        {"effect_size": F.lit(effect_size), "alpha": F.lit(alpha)}
    )
