"""Descriptive, variance, ranking and resampling queries over the cell views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import describe as D
from gaugeframe.operators import ranking as R
from gaugeframe.operators import resampling as H
from gaugeframe.operators import variance as V
from gaugeframe.plans import sql as S
from gaugeframe.plans.registry import query
from gaugeframe.plans.views import cells, cells_close, cells_graded

FACETS = list(V.FACETS)
B = 100
SEED = 42

_DESC_COLS = """count(y) AS count, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min,
    quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q75, max(y) AS max,
    stddev_samp(y) / sqrt(count(y)) AS sem"""
_DESC_D = "mean std min q25 median q75 max sem"


@query("e1_describe_by", f"SELECT model, {_DESC_COLS} FROM (SELECT model, metric_value AS y FROM cells_graded) GROUP BY model", _DESC_D)
def e1(spark, sf):
    return D.describe_by(cells_graded(spark, sf), "model")


@query("e1_describe_by_approximate", None)
def e1a(spark, sf):
    return D.describe_by(cells_graded(spark, sf), "model", approximate=True)


@query("e2_describe_all", f"SELECT facet AS factor, level, {_DESC_COLS} FROM ({S.long_levels('cells', FACETS)}) GROUP BY 1, 2", _DESC_D)
def e2(spark, sf):
    return D.describe_all(cells(spark, sf), FACETS)


@query(
    "e3_dataset_summary",
    """SELECT count(DISTINCT model) AS n_models, count(DISTINCT task_id) AS n_tasks, count(DISTINCT prompt_id) AS n_prompts,
              count(DISTINCT run_id) AS n_runs, count(DISTINCT temperature) AS n_temperatures,
              count(*) AS n_observations, min(metric_name) AS metric FROM cells""",
)
def e3(spark, sf):
    return D.dataset_summary(cells(spark, sf))


_H2 = f"""WITH {S.row_bootstrap('cells', 'cell_id', B, SEED, 'model')},
ci AS (SELECT model, quantile_cont(stat, 0.025) AS ci_lower, quantile_cont(stat, 0.975) AS ci_upper, count(*) AS n_bootstrap
       FROM boot_stats GROUP BY 1),
obs AS (SELECT model, avg(metric_value) AS mean, count(metric_value) AS n FROM cells GROUP BY 1)"""


@query(
    "e4_performance_table",
    _H2 + f""", d AS (SELECT model, {_DESC_COLS} FROM (SELECT model, metric_value AS y FROM cells) GROUP BY 1)
SELECT model, count, d.mean, std, ci_lower AS ci_95_lower, ci_upper AS ci_95_upper, sem, median FROM d JOIN ci USING (model)""",
    "mean std ci_95_lower ci_95_upper sem median",
)
def e4(spark, sf):
    df = cells(spark, sf)
    ci = H.bootstrap_ci_by(df, "model", id_cols=["cell_id"], n_bootstrap=B, seed=SEED)
    return D.performance_table(D.describe_by(df, "model"), ci, "model")


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {column} AS v FROM {source}),
sp AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
b AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS bin, count(*) AS c FROM v, sp GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, lo + r.bin * ((hi - lo) / {bins}) AS left_edge,
       lo + (r.bin + 1) * ((hi - lo) / {bins}) AS right_edge, coalesce(b.c, 0) AS count
FROM sp, range({bins}) r(bin) LEFT JOIN b ON b.bin = r.bin"""


@query("e5_histogram_scores", _histogram_sql("cells_graded", "metric_value", 20), "left_edge right_edge")
def e5(spark, sf):
    return D.histogram(cells_graded(spark, sf), "metric_value", 20)


_RESID = "WITH " + S.components("cells") + ", resid AS (SELECT y - m - d_model - d_task_id - d_prompt_id - d_run_id - d_temperature AS residual FROM comp_rows)"


@query(
    "e5_histogram_residuals",
    _RESID + ", " + _histogram_sql("resid", "round(residual, 9)", 30)[5:],
    "left_edge right_edge",
)
def e5r(spark, sf):
    # rounded first: a residual on a bin edge must fall the same way whatever the order of summation
    df = V.sequential_residuals(cells(spark, sf)).withColumn("residual", F.round("residual", 9))
    return D.histogram(df, "residual", 30)


@query(
    "e6_compare_point_estimates",
    """WITH s AS (SELECT model, avg(metric_value) AS v FROM cells WHERE run_id <= 3 GROUP BY 1),
f AS (SELECT model, avg(metric_value) AS v FROM cells GROUP BY 1),
j AS (SELECT f.model, s.v AS subset_pass_at_1, f.v AS full_pass_at_1, f.v - s.v AS absolute_difference,
             CAST(rank() OVER (ORDER BY round(s.v, 12) DESC NULLS LAST) AS DOUBLE) AS subset_rank,
             CAST(rank() OVER (ORDER BY round(f.v, 12) DESC NULLS LAST) AS DOUBLE) AS full_rank FROM f LEFT JOIN s USING (model))
SELECT *, full_rank - subset_rank AS rank_difference FROM j
UNION ALL SELECT '__overall__', (SELECT avg(metric_value) FROM cells WHERE run_id <= 3), (SELECT avg(metric_value) FROM cells),
  (SELECT avg(metric_value) FROM cells) - (SELECT avg(metric_value) FROM cells WHERE run_id <= 3), NULL, NULL, NULL""",
    "subset_pass_at_1 full_pass_at_1 absolute_difference subset_rank full_rank rank_difference",
)
def e6(spark, sf):
    full = cells(spark, sf)
    return D.compare_point_estimates(full.filter("run_id <= 3"), full)


@query(
    "e7_run_agreement",
    """WITH c AS (SELECT temperature, CASE WHEN min(metric_value) = max(metric_value) THEN 1.0 ELSE 0.0 END AS same
FROM cells GROUP BY model, task_id, prompt_id, temperature)
SELECT 'temperature' AS scope, temperature, avg(same) AS agreement, count(*) AS n_cells FROM c GROUP BY temperature
UNION ALL SELECT 'overall', NULL, avg(same), count(*) FROM c""",
    "agreement temperature",
)
def e7(spark, sf):
    return D.run_agreement(cells(spark, sf))


# ---- variance ----


@query("f1_variance_components", "WITH " + S.components("cells") + " SELECT component, variance, n FROM comp", "variance")
def f1(spark, sf):
    return V.variance_components(cells(spark, sf))


def _type1_sql(order: list[str], tag: str) -> str:
    steps = [f"{tag}0 AS (SELECT metric_value - avg(metric_value) OVER () AS r, {', '.join(FACETS)} FROM cells)"]
    parts = []
    for i, f in enumerate(order):
        steps.append(f"{tag}{i + 1} AS (SELECT r - avg(r) OVER (PARTITION BY {f}) AS r, {', '.join(FACETS)} FROM {tag}{i})")
        parts.append(
            f"SELECT {i + 1} AS step, '{f}' AS component, (SELECT sum(r * r) FROM {tag}{i}) - (SELECT sum(r * r) FROM {tag}{i + 1}) AS ss"
        )
    parts.append(f"SELECT {len(order) + 1}, 'residual', (SELECT sum(r * r) FROM {tag}{len(order)})")
    steps.append(
        f"{tag} AS (SELECT '{','.join(order)}' AS facet_order, step, component, ss, 100 * ss / (SELECT sum(r * r) FROM {tag}0) AS pct_ss FROM ({' UNION ALL '.join(parts)}))"
    )
    return ",\n".join(steps)


@query("f2_type1_shares", f"WITH {_type1_sql(FACETS, 'q')} SELECT step, component, ss, pct_ss FROM q", "ss pct_ss")
def f2(spark, sf):
    return V.type1_shares(cells(spark, sf))


ORDERS = [
    FACETS,
    ["task_id", "model", "prompt_id", "run_id", "temperature"],
    ["prompt_id", "model", "task_id", "run_id", "temperature"],
    ["temperature", "run_id", "prompt_id", "task_id", "model"],
]


@query(
    "f3_type1_orderings",
    "WITH " + ",\n".join(_type1_sql(o, f"q{chr(97 + i)}") for i, o in enumerate(ORDERS))
    + " " + " UNION ALL ".join(f"SELECT * FROM q{chr(97 + i)}" for i in range(len(ORDERS))),
    "ss pct_ss",
)
def f3(spark, sf):
    return V.type1_orderings(cells(spark, sf), ORDERS)


@query(
    "f4_variance_table",
    "WITH " + S.components("cells")
    + """ SELECT component, variance, 100 * variance / (SELECT greatest(variance, 1e-12) FROM comp WHERE component = 'total') AS pct_total_variance
    FROM comp WHERE component <> 'total'""",
    "variance pct_total_variance",
)
def f4(spark, sf):
    return V.variance_table(cells(spark, sf))


@query("f5_sequential_residuals", "WITH " + S.components("cells").replace("SELECT metric_value AS y", "SELECT cell_id, metric_value AS y", 1)
       + " SELECT cell_id, y - m - d_model - d_task_id - d_prompt_id - d_run_id - d_temperature AS residual FROM comp_rows", "residual")
def f5(spark, sf):
    return V.sequential_residuals(cells(spark, sf)).select("cell_id", "residual")


@query(
    "f6_interaction_shares",
    """WITH r AS (SELECT metric_value AS y, avg(metric_value) OVER () AS m, avg(metric_value) OVER (PARTITION BY model) AS a,
       avg(metric_value) OVER (PARTITION BY task_id) AS b, avg(metric_value) OVER (PARTITION BY model, task_id) AS c FROM cells),
s AS (SELECT sum((a - m) ** 2) AS sm, sum((b - m) ** 2) AS st, sum((c - m) ** 2) AS sc, sum((y - c) ** 2) AS sr, sum((y - m) ** 2) AS t FROM r),
p AS (SELECT 'model' AS component, sm AS ss, t FROM s UNION ALL SELECT 'task', st, t FROM s
      UNION ALL SELECT 'model_x_task', sc - sm - st, t FROM s UNION ALL SELECT 'residual', sr, t FROM s)
SELECT component, ss, 100 * ss / t AS pct_ss FROM p""",
    "ss pct_ss",
)
def f6(spark, sf):
    return V.interaction_shares(cells(spark, sf))


_F7 = [f for f in FACETS if f != "temperature"]


@query(
    "f7_g_study",
    "WITH " + S.components("cells", _F7, "temperature")
    + f" SELECT temperature, component, variance, n, '{','.join(_F7)}' AS facets FROM comp",
    "variance",
)
def f7(spark, sf):
    return V.g_study(cells(spark, sf), _F7, ["temperature"])


_GRID = ([10, 20, 40, 80, 164], [1, 2, 4], [1, 3, 5])


@query(
    "f8_d_study",
    "WITH " + S.components("cells", FACETS, "metric_name")
    + f""", w AS (SELECT *, v_task_id + v_prompt_id + v_run_id AS u FROM comp_wide),
g AS (SELECT *, v_task_id / n_tasks + v_prompt_id / n_prompts + v_run_id / n_runs AS abs_err,
      v_residual / (n_tasks * n_prompts * n_runs) AS rel_err,
      CASE WHEN n_tasks > 1 THEN v_task_id / n_tasks ELSE 0 END + CASE WHEN n_prompts > 1 THEN v_prompt_id / n_prompts ELSE 0 END
      + CASE WHEN n_runs > 1 THEN v_run_id / n_runs ELSE 0 END AS phi_err
      FROM w, (SELECT unnest({_GRID[0]}) AS n_tasks), (SELECT unnest({_GRID[1]}) AS n_prompts), (SELECT unnest({_GRID[2]}) AS n_runs))
SELECT metric_name, n_tasks, n_prompts, n_runs, u / (u + v_residual) AS g_coefficient,
       u / (u + v_residual + phi_err) AS phi_coefficient, v_residual + abs_err AS expected_observed_variance,
       v_model / (v_model + rel_err) AS g_rel, v_model / (v_model + abs_err + rel_err) AS phi_abs FROM g""",
    "g_coefficient phi_coefficient expected_observed_variance g_rel phi_abs",
)
def f8(spark, sf):
    return V.d_study(cells(spark, sf), *_GRID, by=["metric_name"])


_ENDS = f"""long AS ({S.long_levels('cells_graded', FACETS)}),
lv AS (SELECT facet, level, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM long GROUP BY 1, 2),
ends AS (SELECT facet, arg_max(level, row(round(mean, 12), level)) AS hi, arg_min(level, row(round(mean, 12), level)) AS lo
         FROM lv GROUP BY 1 HAVING count(*) >= 2),
cd AS (SELECT e.facet AS factor, e.hi AS high_level, e.lo AS low_level,
       (h.mean - l.mean) / sqrt(((h.n - 1) * h.var + (l.n - 1) * l.var) / (h.n + l.n - 2)) AS cohens_d
       FROM ends e JOIN lv h ON h.facet = e.facet AND h.level = e.hi JOIN lv l ON l.facet = e.facet AND l.level = e.lo),
hist AS (SELECT facet, level, y, count(*) AS c FROM long GROUP BY 1, 2, 3),
cl AS (SELECT e.facet AS factor,
       CAST(sum(CASE WHEN l.y > h.y THEN h.c * l.c WHEN l.y < h.y THEN -h.c * l.c ELSE 0 END) AS DOUBLE) / sum(h.c * l.c) AS cliffs_delta
       FROM ends e JOIN hist h ON h.facet = e.facet AND h.level = e.hi JOIN hist l ON l.facet = e.facet AND l.level = e.lo GROUP BY 1)"""


@query("f11_cohens_d", f"WITH {_ENDS} SELECT * FROM cd", "cohens_d")
def f11(spark, sf):
    return V.cohens_d(cells_graded(spark, sf), FACETS)


@query(
    "f12_cliffs_delta",
    f"WITH {_ENDS} SELECT factor, cliffs_delta, -cliffs_delta AS cliffs_delta_high_minus_low FROM cl",
    "cliffs_delta cliffs_delta_high_minus_low",
)
def f12(spark, sf):
    return V.cliffs_delta(cells_graded(spark, sf), FACETS)


@query(
    "f14_publication_effects",
    f"WITH {_ENDS}, {S.components('cells_graded')}, tv AS (SELECT variance AS t FROM comp WHERE component = 'total')"
    """, nl AS (SELECT facet, count(*) AS k FROM lv GROUP BY 1)
SELECT cd.factor, high_level || ' vs ' || low_level AS contrast, cohens_d, cliffs_delta, variance / t AS eta_squared,
       greatest((variance - (k - 1) * t * 0.01) / (t + t * 0.01), 0) AS omega_squared_pub, variance AS variance_component
FROM cd JOIN cl USING (factor) JOIN comp ON component = cd.factor JOIN nl ON nl.facet = cd.factor, tv""",
    "cohens_d cliffs_delta eta_squared omega_squared_pub variance_component",
)
def f14(spark, sf):
    return V.publication_effects(cells_graded(spark, sf))


@query(
    "f15_prompt_effect",
    "SELECT stddev_pop(m) AS prompt_effect_std FROM (SELECT avg(metric_value) AS m FROM cells_graded GROUP BY prompt_id)",
    "prompt_effect_std",
)
def f15(spark, sf):
    return V.prompt_effect(cells_graded(spark, sf))


@query(
    "f16_pass_fail_frame",
    """SELECT d.source AS model_id, d.lang AS prompt_variant_id, CAST(d.doc_id AS VARCHAR) AS task_id, CAST(0 AS INTEGER) AS run_index,
    0.0::DOUBLE AS temperature, CAST(CASE WHEN l.quality >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pass_fail
    FROM documents d JOIN labels l USING (doc_id)""",
)
def f16(spark, sf):
    from gaugeframe.plans.views import table

    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("model"), F.col("lang").alias("prompt_id"), F.col("doc_id").alias("task"),
        F.lit(0).alias("run_id"), F.lit(0.0).alias("temperature"), F.col("quality").alias("metric_value"),
    )
    return V.pass_fail_frame(df)


# ---- ranking ----


@query("g1_model_scores", "SELECT model, avg(metric_value) AS score FROM cells GROUP BY 1", "score")
def g1(spark, sf):
    return R.model_scores(cells(spark, sf))


# task means of one model repeat often, so this ranks with many ties
@query(
    "g2_rank_models",
    f"SELECT task_id, model, score, {S.avg_rank('score', 'task_id')} AS rank FROM (SELECT task_id, model, round(avg(metric_value), 1) AS score FROM cells GROUP BY 1, 2)",
    "score rank",
)
def g2(spark, sf):
    scores = cells(spark, sf).groupBy("task_id", "model").agg(F.round(F.avg("metric_value"), 1).alias("score"))
    return R.with_rank(scores, ["task_id"])


_MODELS = [f"m{i}" for i in range(6)]


@query(
    "g3_score_matrix",
    "SELECT task_id, " + ", ".join(f"avg(metric_value) FILTER (WHERE model = '{m}') AS {m}" for m in _MODELS) + " FROM cells GROUP BY 1",
    " ".join(_MODELS),
)
def g3(spark, sf):
    return R.score_matrix(cells(spark, sf), "task_id", _MODELS)


@query(
    "g4_kendall_tau",
    f"""WITH t AS (SELECT task_id, model, avg(metric_value) AS s FROM cells_close GROUP BY 1, 2), {S.base('cells_close')},
x AS (SELECT t.task_id, t.model, base.rank AS base_rank, {S.avg_rank('round(t.s, 1)', 't.task_id')} AS rank FROM t JOIN base USING (model)),
{S.taus('x', 'task_id', 'base_rank', 'rank')} SELECT task_id, coalesce(tau, 1.0) AS kendall_tau FROM taus""",
    "kendall_tau",
)
def g4(spark, sf):
    df = cells_close(spark, sf)
    base = R.baseline_rankings(df).select("model", F.col("rank").alias("base_rank"))
    scores = df.groupBy("task_id", "model").agg(F.round(F.avg("metric_value"), 1).alias("score"))
    ranked = R.with_rank(scores.join(base, "model"), ["task_id"])
    return R.kendall_tau(ranked, "base_rank", "rank", ["task_id"])


@query(
    "g5_rank_change_rate",
    f"""WITH t AS (SELECT task_id, model, round(avg(metric_value), 1) AS s FROM cells_close GROUP BY 1, 2), {S.base('cells_close')},
x AS (SELECT t.task_id, t.model, base.rank AS base_rank, base.position, {S.avg_rank('t.s', 't.task_id')} AS rank FROM t JOIN base USING (model)),
y AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY base_rank DESC, position) AS r0,
      row_number() OVER (PARTITION BY task_id ORDER BY rank DESC, position) AS r1 FROM x)
SELECT task_id, avg(CASE WHEN r0 <> r1 THEN 1.0 ELSE 0.0 END) AS rank_change_rate FROM y GROUP BY 1""",
    "rank_change_rate",
)
def g5(spark, sf):
    df = cells_close(spark, sf)
    base = R.baseline_rankings(df).select("model", F.col("rank").alias("base_rank"), "position")
    scores = df.groupBy("task_id", "model").agg(F.round(F.avg("metric_value"), 1).alias("score"))
    ranked = R.with_rank(scores.join(base, "model"), ["task_id"])
    return R.rank_change_rate(ranked, ["task_id"], "base_rank", "rank", "position")


_G6 = "WITH " + S.samples("cells_close", ["task_id"], B, SEED)
_G7 = "WITH " + S.samples("cells_close", R.BOOTSTRAP_FACETS, B, SEED)
_SAMPLE_D = "score rank kendall_tau rank_changed"


def _samples(spark, sf):
    return R.bootstrap_all_facets(cells_close(spark, sf), n_bootstrap=B, seed=SEED)


@query("g6_bootstrap_rankings", _G6 + " SELECT * FROM samples", _SAMPLE_D)
def g6(spark, sf):
    return R.bootstrap_rankings(cells_close(spark, sf), "task_id", B, SEED)


@query("g7_bootstrap_all_facets", _G7 + " SELECT * FROM samples", _SAMPLE_D)
def g7(spark, sf):
    return _samples(spark, sf)


@query(
    "g8_rank_probabilities",
    _G7 + """, ms AS (SELECT DISTINCT model FROM samples),
rk AS (SELECT DISTINCT rank FROM samples UNION SELECT CAST(unnest(range(1, (SELECT count(*) + 1 FROM ms))) AS DOUBLE)),
c AS (SELECT model, rank, count(*) AS c FROM samples GROUP BY 1, 2)
SELECT ms.model, rk.rank, coalesce(c.c, 0) / (SELECT sum(c.c) FROM c WHERE c.model = ms.model) AS probability
FROM ms CROSS JOIN rk LEFT JOIN c ON c.model = ms.model AND c.rank = rk.rank""",
    "rank probability",
)
def g8(spark, sf):
    return R.rank_probabilities(_samples(spark, sf))


@query(
    "g9_pairwise_reversal",
    _G7 + """ SELECT a.model AS model_a, b.model AS model_b, avg(CASE WHEN x.rank < y.rank THEN 0.0 ELSE 1.0 END) AS reversal_probability,
count(*) AS n_iterations FROM base a JOIN base b ON a.position < b.position JOIN samples x ON x.model = a.model
JOIN samples y ON y.model = b.model AND y.iteration = x.iteration AND y.bootstrap_type = x.bootstrap_type GROUP BY 1, 2""",
    "reversal_probability",
)
def g9(spark, sf):
    return R.pairwise_reversal(_samples(spark, sf), R.baseline_rankings(cells_close(spark, sf)))


_FRAG = """max(m) AS n_models, count(*) AS n_bootstrap, avg(tau) AS kendall_tau_mean, stddev_pop(tau) AS kendall_tau_std,
min(tau) AS kendall_tau_min, avg(ch) AS rank_change_rate, (1 - avg(tau)) / 2 AS fragility_index"""


@query(
    "g10_fragility_summary",
    _G7 + f""", i AS (SELECT bootstrap_type, iteration, max(kendall_tau) AS tau, max(rank_changed) AS ch, count(*) AS m FROM samples GROUP BY 1, 2)
SELECT 'pass_at_1' AS metric_name, bootstrap_type, {_FRAG} FROM i GROUP BY 2 UNION ALL SELECT 'pass_at_1', 'overall', {_FRAG} FROM i""",
    "kendall_tau_mean kendall_tau_std kendall_tau_min rank_change_rate fragility_index",
)
def g10(spark, sf):
    return R.fragility_summary(_samples(spark, sf), "pass_at_1")


@query("g11_baseline_rankings", f"WITH {S.base('cells')} SELECT model, score, rank FROM base", "score rank")
def g11(spark, sf):
    return R.baseline_rankings(cells(spark, sf)).drop("position")


P12 = 1000
_U = "(CAST(('0x' || substr(md5(concat_ws('|', 42, it, model)), {at}, 8))::BIGINT AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE"
_G12 = f"""WITH {S.base('cells_close')},
n AS (SELECT it, model, rank, score + 0.01::DOUBLE * sqrt(-2.0 * ln({_U.format(at=1)})) * cos(2.0 * pi() * {_U.format(at=9)}) AS noisy
      FROM base, range({P12}) r(it)),
x AS (SELECT *, {S.avg_rank('noisy', 'it')} AS noisy_rank FROM n),
mv AS (SELECT it, max(CASE WHEN r0 <> r1 THEN 1 ELSE 0 END) AS ch, count(*) AS m FROM (SELECT it,
   row_number() OVER (PARTITION BY it ORDER BY rank, model) AS r0, row_number() OVER (PARTITION BY it ORDER BY noisy_rank, model) AS r1 FROM x) GROUP BY 1),
{S.taus('x', 'it', 'rank', 'noisy_rank')}
SELECT max(m) AS n_models, count(*) AS n_perturbations, CAST(sum(ch) AS BIGINT) AS rank_changes, avg(ch) AS fragility_rate,
       avg(coalesce(tau, 1.0)) AS kendall_tau_mean, stddev_pop(coalesce(tau, 1.0)) AS kendall_tau_std FROM mv JOIN taus USING (it)"""


@query("g12_noise_fragility", _G12, "fragility_rate kendall_tau_mean kendall_tau_std")
def g12(spark, sf):
    return R.noise_fragility(cells_close(spark, sf), 0.01, P12, SEED)


_Q3 = "quantile_cont({c}, 0.025) AS ci_lower, quantile_cont({c}, 0.5) AS ci_median, quantile_cont({c}, 0.975) AS ci_upper"


@query(
    "g13_ranking_ci",
    _G7 + f""", t AS (SELECT bootstrap_type, iteration, max(kendall_tau) AS tau FROM samples GROUP BY 1, 2),
d AS (SELECT iteration, (1 - avg(tau)) / 2 AS f FROM (SELECT DISTINCT iteration, tau FROM t) GROUP BY 1)
SELECT 'kendall_tau' AS metric, avg(tau) AS point_estimate, {_Q3.format(c='tau')} FROM t
UNION ALL SELECT 'fragility_index', (SELECT (1 - avg(tau)) / 2 FROM t), {_Q3.format(c='f')} FROM d""",
    "point_estimate ci_lower ci_median ci_upper",
)
def g13(spark, sf):
    return R.ranking_ci(_samples(spark, sf))[0]


@query(
    "g13_rank_ci",
    _G7 + """ SELECT model, quantile_cont(rank, 0.5) AS rank_median, quantile_cont(rank, 0.025) AS rank_ci_lower,
    quantile_cont(rank, 0.975) AS rank_ci_upper FROM samples GROUP BY 1""",
    "rank_median rank_ci_lower rank_ci_upper",
)
def g13r(spark, sf):
    return R.ranking_ci(_samples(spark, sf))[1]


@query(
    "g14_pairwise_gaps",
    f"WITH {S.base('cells')} SELECT a.model AS model_a, b.model AS model_b, abs(a.score - b.score) AS gap FROM base a JOIN base b ON a.model < b.model",
    "gap",
)
def g14(spark, sf):
    return R.pairwise_gaps(cells(spark, sf))


@query(
    "g15_cluster_ci",
    _G6 + """ SELECT model, base.score AS mean, lo AS ci_lower, hi AS ci_upper FROM base JOIN
(SELECT model, quantile_cont(score, 0.025) AS lo, quantile_cont(score, 0.975) AS hi FROM scores GROUP BY 1) USING (model)""",
    "mean ci_lower ci_upper",
)
def g15(spark, sf):
    return R.cluster_ci(cells_close(spark, sf), "task_id", B, SEED)


@query(
    "g16_pairwise_cluster_ci",
    _G6 + """, d AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS d FROM scores a JOIN scores b
   ON a.iteration = b.iteration AND a.model < b.model),
q AS (SELECT model_a, model_b, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY 1, 2)
SELECT model_a, model_b, x.score - y.score AS difference, lo AS ci_lower, hi AS ci_upper, lo <= 0 AND hi >= 0 AS includes_zero
FROM q JOIN base x ON x.model = model_a JOIN base y ON y.model = model_b""",
    "difference ci_lower ci_upper",
)
def g16(spark, sf):
    return R.pairwise_cluster_ci(cells_close(spark, sf), "task_id", B, SEED)


# ---- resampling ----


@query(
    "h1_bootstrap_ci",
    f"""WITH {S.row_bootstrap('cells', 'cell_id', B, SEED)}
SELECT (SELECT avg(metric_value) FROM cells) AS statistic, (SELECT count(metric_value) FROM cells) AS n,
       quantile_cont(stat, 0.025) AS ci_lower, quantile_cont(stat, 0.975) AS ci_upper, count(*) AS n_bootstrap FROM boot_stats""",
    "statistic ci_lower ci_upper",
)
def h1(spark, sf):
    return H.bootstrap_ci(cells(spark, sf), "metric_value", ["cell_id"], n_bootstrap=B, seed=SEED)


@query("h1_bootstrap_ci_by_counts", None)
def h1c(spark, sf):
    return H.bootstrap_ci(cells(spark, sf), "metric_value", n_bootstrap=1000, seed=SEED)


@query("h2_bootstrap_ci_by", _H2 + " SELECT model, mean, n, ci_lower, ci_upper, n_bootstrap FROM obs JOIN ci USING (model)", "mean ci_lower ci_upper")
def h2(spark, sf):
    return H.bootstrap_ci_by(cells(spark, sf), "model", id_cols=["cell_id"], n_bootstrap=B, seed=SEED)


SIZES = [10, 20, 40, 60, 80, 120, 164]
SUBSETS = 100
TSEED = 20260404
_SUBS = "WITH " + S.subset_scores("cells_close", SIZES, SUBSETS, TSEED)
_H3 = _SUBS + f""",
rk AS (SELECT sub.*, ref.full_rank, ref.position, {S.avg_rank('score', 'n_requested, subset_index')} AS rank FROM sub JOIN ref USING (model)),
{S.taus('rk', 'n_requested, subset_index', 'full_rank', 'rank')},
rv AS (SELECT a.n_requested, a.subset_index, avg(CASE WHEN round(a.score, 12) >= round(b.score, 12) THEN 0.0 ELSE 1.0 END) AS pairwise_reversal_rate
       FROM rk a JOIN rk b ON a.n_requested = b.n_requested AND a.subset_index = b.subset_index AND a.position < b.position GROUP BY 1, 2),
ov AS (SELECT n_requested, subset_index, avg(score) AS overall_pass_at_1 FROM sub GROUP BY 1, 2),
pe AS (SELECT stddev_pop(m) AS prompt_effect_std FROM (SELECT avg(metric_value) AS m FROM cells_close GROUP BY prompt_id)),
sim AS (SELECT n_tasks, subset_index, tau AS kendall_tau, pairwise_reversal_rate, prompt_effect_std, overall_pass_at_1
        FROM sizes JOIN taus USING (n_requested, subset_index) JOIN rv USING (n_requested, subset_index) JOIN ov USING (n_requested, subset_index), pe)"""


def _sim(spark, sf):
    return H.task_subsets(cells_close(spark, sf), SIZES, SUBSETS, TSEED)


@query(
    "h3_task_subsets",
    _H3 + " SELECT *, CAST(NULL AS DOUBLE) AS g_coefficient_task FROM sim",
    "kendall_tau pairwise_reversal_rate prompt_effect_std overall_pass_at_1",
)
def h3(spark, sf):
    return _sim(spark, sf)


@query(
    "h4_reversal_rate",
    f"""WITH {S.base('cells_close')}, t AS (SELECT task_id, model, avg(metric_value) AS s FROM cells_close GROUP BY 1, 2)
SELECT a.task_id, avg(CASE WHEN round(a.s, 12) >= round(b.s, 12) THEN 0.0 ELSE 1.0 END) AS pairwise_reversal_rate
FROM t a JOIN t b ON a.task_id = b.task_id JOIN base x ON x.model = a.model JOIN base y ON y.model = b.model
WHERE x.position < y.position GROUP BY 1""",
    "pairwise_reversal_rate",
)
def h4(spark, sf):
    df = cells_close(spark, sf)
    base = R.baseline_rankings(df).select("model", "position")
    scores = df.groupBy("task_id", "model").agg(F.avg("metric_value").alias("score")).join(base, "model")
    return R.reversal_rate(scores, ["task_id"], "position", "score")


_THRESH = """th AS (SELECT t.target, n_tasks, avg(CASE WHEN kendall_tau >= t.target THEN 1.0 ELSE 0.0 END) AS sh
   FROM sim, (VALUES (0.9::DOUBLE), (0.95::DOUBLE)) t(target) GROUP BY 1, 2),
rec AS (SELECT 'kendall_tau' AS metric, target, min(n_tasks) FILTER (WHERE sh >= 0.8) AS n FROM th GROUP BY 2)"""


@query(
    "h5_reliability_thresholds",
    _H3 + f""", {_THRESH} SELECT metric, target, n AS recommended_min_tasks_80pct_subsets FROM rec
UNION ALL SELECT 'g_coefficient_task', unnest([0.8::DOUBLE, 0.9::DOUBLE]), NULL""",
    "target",
)
def h5(spark, sf):
    return H.reliability_thresholds(_sim(spark, sf))


@query(
    "h6_rank_uncertainty",
    _H3 + """ SELECT n_tasks, stddev_samp(overall_pass_at_1) AS pass_at_1_std, quantile_cont(kendall_tau, 0.5) AS kendall_tau_median,
quantile_cont(kendall_tau, 0.05) AS kendall_tau_p05, quantile_cont(kendall_tau, 0.95) AS kendall_tau_p95 FROM sim GROUP BY 1""",
    "pass_at_1_std kendall_tau_median kendall_tau_p05 kendall_tau_p95",
)
def h6(spark, sf):
    return H.rank_uncertainty(_sim(spark, sf))


DELTAS = [0.05, 0.10, 0.15, 0.20, 0.25]
_H7 = "WITH " + S.subset_scores("cells", SIZES, SUBSETS, TSEED) + f""",
gp AS (SELECT a.model AS hi, b.model AS lo, a.full_score - b.full_score AS gap FROM ref a JOIN ref b
       ON a.full_score > b.full_score),
dl AS (SELECT unnest({DELTAS}) :: DOUBLE AS delta),
ok AS (SELECT delta, s.n_requested, s.subset_index, bool_and(round(s.score, 12) > round(t.score, 12)) AS kept
       FROM dl JOIN gp ON round(gap, 12) >= delta JOIN sub s ON s.model = hi
       JOIN sub t ON t.model = lo AND t.n_requested = s.n_requested AND t.subset_index = s.subset_index GROUP BY 1, 2, 3),
pc AS (SELECT delta, count(*) AS pairs FROM dl JOIN gp ON round(gap, 12) >= delta GROUP BY 1),
cv AS (SELECT delta, n_tasks, avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END) AS preserve_rate, max(pairs) AS pairs
       FROM ok JOIN sizes USING (n_requested, subset_index) JOIN pc USING (delta) GROUP BY 1, 2)"""


@query("h7_order_preservation_curve", _H7 + " SELECT * FROM cv", "delta preserve_rate")
def h7(spark, sf):
    return H.order_preservation(cells(spark, sf), DELTAS, SIZES, SUBSETS, TSEED)[0]


@query(
    "h7_order_preservation",
    _H7 + """ SELECT delta, max(pairs) AS pairs, min(n_tasks) FILTER (WHERE round(preserve_rate, 12) >= 0.8) AS nt_80,
    (SELECT max(gap) FROM gp) AS max_gap FROM cv GROUP BY 1""",
    "delta max_gap",
)
def h7s(spark, sf):
    return H.order_preservation(cells(spark, sf), DELTAS, SIZES, SUBSETS, TSEED)[1]


_CONV_SIZES = ", ".join(str(s) for s in H.CONVERGENCE_SIZES)
_H8 = f"""WITH pre AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 42, cell_id)), cell_id) AS r FROM cells),
part AS (SELECT pre.*, size FROM pre, (SELECT unnest([{_CONV_SIZES}]) AS size) WHERE r <= size),
{S.components('part', FACETS, 'size')},
{S.base('cells')},
sc AS (SELECT size, model, avg(metric_value) AS score FROM part GROUP BY 1, 2),
rk AS (SELECT sc.*, base.rank AS full_rank, {S.avg_rank('sc.score', 'size')} AS rank FROM sc JOIN base USING (model)),
{S.taus('rk', 'size', 'full_rank', 'rank')},
{S.row_bootstrap('part', 'cell_id', 50, SEED, 'size')},
ci AS (SELECT size, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM boot_stats GROUP BY 1),
lng AS ({S.long_levels('part', ['model', 'prompt_id'], extra='size, ')}),
lv AS (SELECT size, facet, level, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM lng GROUP BY 1, 2, 3),
en AS (SELECT size, facet, arg_max(row(n, mean, var), row(round(mean, 12), level)) AS h, arg_min(row(n, mean, var), row(round(mean, 12), level)) AS l FROM lv GROUP BY 1, 2),
cd AS (SELECT size, facet, (h[2] - l[2]) / sqrt(((h[1] - 1) * h[3] + (l[1] - 1) * l[3]) / (h[1] + l[1] - 2)) AS d FROM en)"""


@query(
    "h8_convergence",
    _H8 + """ SELECT size, n AS n_observations, coalesce(tau, 1.0) AS kendall_tau_vs_full_ranking, v_model AS model_variance, v_prompt_id AS prompt_variance,
v_task_id AS task_variance, v_residual AS residual_variance, 100 * v_model / greatest(v_total, 1e-12) AS explained_variance_model_pct,
100 * v_prompt_id / greatest(v_total, 1e-12) AS explained_variance_prompt_pct, lo AS mean_metric_ci_lower, hi AS mean_metric_ci_upper,
a.d AS cohens_d_model, b.d AS cohens_d_prompt
FROM comp_wide JOIN taus USING (size) JOIN ci USING (size) JOIN cd a USING (size) JOIN cd b USING (size) WHERE a.facet = 'model' AND b.facet = 'prompt_id'""",
    "kendall_tau_vs_full_ranking model_variance prompt_variance task_variance residual_variance explained_variance_model_pct explained_variance_prompt_pct mean_metric_ci_lower mean_metric_ci_upper cohens_d_model cohens_d_prompt",
)
def h8(spark, sf):
    return H.convergence(cells(spark, sf), ["cell_id"], seed=SEED, n_bootstrap=50)


_H9_PARTS = " UNION ALL ".join(
    f"SELECT '{lab}|' || k.lv AS dk, c.* FROM cells_graded c, (SELECT DISTINCT CAST({f} AS VARCHAR) AS lv FROM cells_graded) k WHERE CAST(c.{f} AS VARCHAR) <> k.lv"
    for f, lab in H.DROPPED_FACETS.items()
)
_H9 = f"""WITH dr AS ({_H9_PARTS}),
{S.components('dr', FACETS, 'dk', name='c1')}, {S.components('cells_graded', FACETS, name='c0')}, {S.base('cells_graded')},
sc AS (SELECT dk, model, avg(metric_value) AS score FROM dr GROUP BY 1, 2),
rk AS (SELECT sc.*, base.rank AS full_rank, {S.avg_rank('sc.score', 'dk')} AS rank FROM sc JOIN base USING (model)),
{S.taus('rk', 'dk', 'full_rank', 'rank')},
loo AS (SELECT split_part(dk, '|', 1) AS dropped_factor, split_part(dk, '|', 2) AS dropped_level, a.n AS n_observations,
       coalesce(tau, 1.0) AS kendall_tau_vs_full, a.v_model - b.v_model AS model_variance_change,
       a.v_prompt_id - b.v_prompt_id AS prompt_variance_change, a.v_task_id - b.v_task_id AS task_variance_change,
       a.v_residual - b.v_residual AS residual_variance_change FROM c1_wide a JOIN taus USING (dk), c0_wide b)"""


@query(
    "h9_leave_one_out",
    _H9 + " SELECT * FROM loo",
    "kendall_tau_vs_full model_variance_change prompt_variance_change task_variance_change residual_variance_change",
)
def h9(spark, sf):
    return H.leave_one_out(cells_graded(spark, sf))


@query(
    "h9_leave_one_out_summary",
    _H9 + """ SELECT dropped_factor, count(*) AS n_levels, min(kendall_tau_vs_full) AS kendall_tau_min,
    quantile_cont(kendall_tau_vs_full, 0.5) AS kendall_tau_median FROM loo GROUP BY 1""",
    "kendall_tau_min kendall_tau_median",
)
def h9s(spark, sf):
    return H.leave_one_out_summary(H.leave_one_out(cells_graded(spark, sf)))


@query(
    "h10_design_guidance",
    _H3 + f""", {_THRESH}, {S.components('cells_close')}
SELECT 'minimum_tasks_for_g_' || unnest(['0_80', '0_90']) AS recommendation, NULL AS value, 'not_supported' AS status, 'distinct G over the grid: 1' AS notes
UNION ALL SELECT 'minimum_tasks_for_kendall_tau_' || replace(CAST(target AS VARCHAR), '.', '_'), CAST(n AS VARCHAR), 'estimated', 'smallest size with 80% of subsets at the target' FROM rec
UNION ALL SELECT 'marginal_benefit_additional_prompts', 'prompt', 'estimated_descriptive_anova', 'descriptive share, not a reliability gain'
UNION ALL SELECT 'marginal_benefit_additional_runs', 'run', 'estimated_descriptive_anova', 'descriptive share, not a reliability gain'
UNION ALL SELECT 'scope_note', 'pass_at_1', 'stated', 'holds for the analysed design only'""",
)
def h10(spark, sf):
    thresholds = H.reliability_thresholds(_sim(spark, sf))
    rows = H.design_guidance(cells_close(spark, sf), thresholds)
    # the JSON shares are checked on their own below; number formats differ between engines
    kind = F.regexp_extract("recommendation", "additional_(prompt|run)s", 1)
    return rows.withColumn("value", F.when(F.col("value").startswith("{"), kind).otherwise(F.col("value")))


@query(
    "h10_guidance_shares",
    "WITH " + S.components("cells_close") + """, t AS (SELECT greatest(v_total, 1e-12) AS t, * FROM comp_wide)
SELECT 'marginal_benefit_additional_prompts' AS recommendation, round(100 * v_prompt_id / t, 4) AS share_pct, v_prompt_id AS variance FROM t
UNION ALL SELECT 'marginal_benefit_additional_runs', round(100 * v_run_id / t, 4), v_run_id FROM t""",
    "share_pct variance",
)
def h10s(spark, sf):
    rows = H.design_guidance(cells_close(spark, sf)).filter(F.col("value").startswith("{"))
    name = F.regexp_extract("recommendation", "additional_(prompt|run)s", 1)

    def field(suffix: str):
        return F.coalesce(
            F.get_json_object("value", f"$.prompt_{suffix}"), F.get_json_object("value", f"$.run_{suffix}")
        ).cast("double")

    return rows.filter(name != "").select("recommendation", field("variance_share_pct").alias("share_pct"), field("variance").alias("variance"))
