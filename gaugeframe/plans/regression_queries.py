"""ANOVA, regression, mixed-model and power queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import regression as M
from gaugeframe.operators import resampling as H
from gaugeframe.operators import variance as V
from gaugeframe.plans import sql as S
from gaugeframe.plans.registry import query
from gaugeframe.plans.views import cells, cells_balanced, cells_by_task, cells_graded, table

BAL = ("model", "prompt_id", "temperature", "run_id")

# In a balanced design the sum of squares of a factor does not depend on the others.
_BALANCED = f"""{S.components('cells_balanced', BAL)},
k AS (SELECT 'model' AS f, count(DISTINCT model) AS l FROM cells_balanced UNION ALL SELECT 'prompt_id', count(DISTINCT prompt_id) FROM cells_balanced
      UNION ALL SELECT 'temperature', count(DISTINCT temperature) FROM cells_balanced UNION ALL SELECT 'run_id', count(DISTINCT run_id) FROM cells_balanced),
e AS (SELECT variance * (n - 1) AS sse, n - 1 - (SELECT sum(l - 1) FROM k) AS dfe, variance * (n - 1) / (n - 1 - (SELECT sum(l - 1) FROM k)) AS mse, n
      FROM comp WHERE component = 'residual'),
s AS (SELECT component AS term, variance * (comp.n - 1) AS sum_sq, CAST(l - 1 AS DOUBLE) AS df FROM comp JOIN k ON f = component),
th AS (SELECT (SELECT avg(metric_value) FROM cells_balanced WHERE model = 'm0') + (SELECT avg(metric_value) FROM cells_balanced WHERE prompt_id = 'A')
   + (SELECT avg(metric_value) FROM cells_balanced WHERE temperature = 0) + (SELECT avg(metric_value) FROM cells_balanced WHERE run_id = (SELECT min(run_id) FROM cells_balanced))
   - 3 * (SELECT avg(metric_value) FROM cells_balanced) AS t, (SELECT sum(l) - 3 FROM k) AS q),
s3 AS (SELECT * FROM s UNION ALL SELECT 'Intercept', t * t / (q / e.n), 1 FROM th, e)"""
_EFFECTS = """sum_sq, df, sum_sq / df / mse AS f_stat, sum_sq / (sum_sq + sse) AS partial_eta_squared,
greatest((sum_sq - df * mse) / ((SELECT sum(sum_sq) FROM {t}) + sse + mse), 0) AS omega_squared"""
_AD = "sum_sq df f_stat p_value partial_eta_squared omega_squared"


def _with_p(table: str) -> str:
    """The ANOVA table of the sums of squares in `table`, with p-values."""
    return f"""x AS (SELECT term, dfe, {_EFFECTS.format(t=table)} FROM {table}, e), pv AS ({S.f_tail('x')})"""


@query("f9_anova_type2", f"WITH {_BALANCED}, {_with_p('s')} SELECT x.* EXCLUDE dfe, p_value FROM x JOIN pv USING (term)", _AD)
def f9(spark, sf):
    return M.anova(cells_balanced(spark, sf), 2).select("term", *_AD.split())


@query("f9_anova_type2_unbalanced", None)
def f9u(spark, sf):
    return M.anova(cells_graded(spark, sf), 2)


@query("f10_anova_type3", f"WITH {_BALANCED}, {_with_p('s3')} SELECT x.* EXCLUDE dfe, p_value, term = 'Intercept' AS is_intercept FROM x JOIN pv USING (term)", _AD)
def f10(spark, sf):
    return M.anova(cells_balanced(spark, sf), 3).select("term", *_AD.split(), "is_intercept")


@query("f10_method_comparison", None)
def f10m(spark, sf):
    df = cells_graded(spark, sf)
    return M.method_comparison(M.anova(df, 2), M.anova(df, 3), M.random_intercept_lmm(df))


_ENDS = f"""long AS ({S.long_levels('cells_balanced', BAL)}),
lv AS (SELECT facet, level, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM long GROUP BY 1, 2),
ends AS (SELECT facet, arg_max(level, row(round(mean, 12), level)) AS hi, arg_min(level, row(round(mean, 12), level)) AS lo FROM lv GROUP BY 1),
cd AS (SELECT e.facet, (h.mean - l.mean) / sqrt(((h.n - 1) * h.var + (l.n - 1) * l.var) / (h.n + l.n - 2)) AS d
       FROM ends e JOIN lv h ON h.facet = e.facet AND h.level = e.hi JOIN lv l ON l.facet = e.facet AND l.level = e.lo),
cl AS (SELECT e.facet, avg(CASE WHEN l.y > h.y THEN 1.0 WHEN l.y < h.y THEN -1.0 ELSE 0 END) AS delta
       FROM ends e JOIN long h ON h.facet = e.facet AND h.level = e.hi JOIN long l ON l.facet = e.facet AND l.level = e.lo GROUP BY 1)"""


@query(
    "f13_factor_effect_sizes",
    f"""WITH {_BALANCED}, {_ENDS}, {_with_p('s')}
SELECT x.term AS factor, d AS cohens_d, delta AS cliffs_delta, -delta AS cliffs_delta_high_minus_low, partial_eta_squared, omega_squared, p_value AS p_value_type2
FROM x JOIN pv USING (term) JOIN cd ON cd.facet = term JOIN cl ON cl.facet = term""",
    "cohens_d cliffs_delta cliffs_delta_high_minus_low partial_eta_squared omega_squared p_value_type2",
)
def f13(spark, sf):
    return M.factor_effect_sizes(cells_balanced(spark, sf))


def _corpus(spark, sf):
    """Documents with their quality label: model = source, prompt = language, task = document."""
    return V.pass_fail_frame(
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
            F.col("source").alias("model"), F.col("lang").alias("prompt_id"), F.col("doc_id").alias("task"),
            F.lit(0).alias("run_id"), (F.col("n_chars") > 2000).cast("double").alias("temperature"), F.col("quality").alias("metric_value"),
        )
    )


def _by_model(spark, sf):
    """Cells with the model as the only varying factor."""
    return V.pass_fail_frame(cells(spark, sf)).withColumns({"prompt_variant_id": F.lit("p"), "temperature": F.lit(0.0)})


_LOGIT = """m AS (SELECT model, count(*) AS n, avg(metric_value) AS p FROM cells GROUP BY 1),
b AS (SELECT * FROM m WHERE model = 'm0'),
c AS (SELECT 'const' AS term, ln(p / (1 - p)) AS est, sqrt(1 / (n * p * (1 - p))) AS se FROM b
UNION ALL SELECT 'model_id_' || m.model, ln(m.p / (1 - m.p)) - ln(b.p / (1 - b.p)), sqrt(1 / (m.n * m.p * (1 - m.p)) + 1 / (b.n * b.p * (1 - b.p)))
FROM m, b WHERE m.model <> 'm0')"""
_OR = f"term, est AS log_odds_estimate, se AS std_error, est / se AS z, {S.normal_tails('est / se')} AS p_value, exp(est) AS odds_ratio, exp(est - 1.96 * se) AS or_ci_lower, exp(est + 1.96 * se) AS or_ci_upper"
_OR_D = "log_odds_estimate std_error z p_value odds_ratio or_ci_lower or_ci_upper"


@query("f17_binomial_glm", f"WITH {_LOGIT} SELECT {_OR} FROM c", _OR_D)
def f17(spark, sf):
    return M.binomial_glm(_by_model(spark, sf)).coefficients(spark).select("term", *_OR_D.split())


@query("f17_binomial_glm_corpus", None)
def f17c(spark, sf):
    return M.binomial_glm(_corpus(spark, sf)).coefficients(spark)


_CLUSTER = f"""{_LOGIT}, u AS (SELECT c.task_id, c.model, sum(c.metric_value) - count(*) * any_value(m.p) AS u, any_value(m.n * m.p * (1 - m.p)) AS w
   FROM cells c JOIN m USING (model) GROUP BY 1, 2),
tk AS (SELECT DISTINCT task_id FROM cells), sz AS (SELECT count(*) AS n, count(DISTINCT task_id) AS g, count(DISTINCT model) AS k FROM cells),
f AS (SELECT CAST(g AS DOUBLE) / (g - 1) * (n - 1) / (n - k) AS f FROM sz),
r AS (SELECT 'const' AS term, sqrt(sum((coalesce(ub.u, 0) / (SELECT any_value(w) FROM u WHERE model = 'm0')) ** 2) * (SELECT f FROM f)) AS rse
   FROM tk LEFT JOIN u ub ON ub.task_id = tk.task_id AND ub.model = 'm0'
UNION ALL SELECT 'model_id_' || mm.model, sqrt(sum((coalesce(um.u, 0) / mm.w - coalesce(ub.u, 0) / mb.w) ** 2) * (SELECT f FROM f))
   FROM tk, (SELECT model, n * p * (1 - p) AS w FROM m WHERE model <> 'm0') mm, (SELECT n * p * (1 - p) AS w FROM m WHERE model = 'm0') mb
   LEFT JOIN u um ON um.task_id = tk.task_id AND um.model = mm.model LEFT JOIN u ub ON ub.task_id = tk.task_id AND ub.model = 'm0' GROUP BY mm.model),
cr AS (SELECT c.term, est, rse AS se FROM c JOIN r USING (term))"""


@query("f18_cluster_robust_se", f"WITH {_CLUSTER} SELECT {_OR} FROM cr", _OR_D)
def f18(spark, sf):
    return M.cluster_robust_se(M.binomial_glm(_by_model(spark, sf))).select("term", *_OR_D.split())


@query(
    "f18_compare_fixed_effects",
    f"""WITH {_CLUSTER}, a AS (SELECT {_OR} FROM cr), z AS (SELECT {_OR} FROM c)
SELECT term, a.odds_ratio AS odds_ratio_full, z.odds_ratio AS odds_ratio_reduced, sign(ln(a.odds_ratio)) = sign(ln(z.odds_ratio)) AS same_direction,
NOT (a.or_ci_upper < z.or_ci_lower OR z.or_ci_upper < a.or_ci_lower) AS ci_overlap,
NOT (sign(ln(a.odds_ratio)) = sign(ln(z.odds_ratio)) AND NOT (a.or_ci_upper < z.or_ci_lower OR z.or_ci_upper < a.or_ci_lower)) AS conclusion_changed
FROM a JOIN z USING (term)""",
    "odds_ratio_full odds_ratio_reduced",
)
def f18c(spark, sf):
    fit = M.binomial_glm(_by_model(spark, sf))
    return M.compare_fixed_effects(M.cluster_robust_se(fit), fit.coefficients(spark))


# One row per model and task: REML has the closed form of the two-way table.
_LMM = """WITH y AS (SELECT model, task_id, metric_value AS y, avg(metric_value) OVER (PARTITION BY task_id) AS t,
   avg(metric_value) OVER (PARTITION BY model) AS a, avg(metric_value) OVER () AS g FROM cells_by_task),
z AS (SELECT count(DISTINCT task_id) AS nt, count(DISTINCT model) AS nm, sum((y - t - a + g) ** 2) AS sse, sum((t - g) ** 2) AS sst FROM y),
v0 AS (SELECT *, sse / ((nt - 1) * (nm - 1)) AS mse, sst / (nt - 1) AS mst FROM z),
v AS (SELECT *, CASE WHEN mst > mse THEN mse ELSE (sse + sst) / (nt * nm - nm) END AS s2, greatest((mst - mse) / nm, 0) AS su FROM v0),
ms AS (SELECT model, avg(y) AS m FROM y GROUP BY 1)
SELECT 'Intercept' AS term, 'fixed' AS kind, m AS estimate, sqrt((su + s2) / nt) AS std_err FROM ms, v WHERE model = 'm0'
UNION ALL SELECT 'model_' || model, 'fixed', m - (SELECT m FROM ms WHERE model = 'm0'), sqrt(2 * s2 / nt) FROM ms, v WHERE model <> 'm0'
UNION ALL SELECT 'task_id', 'variance', su, NULL FROM v UNION ALL SELECT 'residual', 'variance', s2, NULL FROM v"""


@query("f19_random_intercept_lmm", _LMM, "estimate std_err")
def f19(spark, sf):
    return M.random_intercept_lmm(cells_by_task(spark, sf)).drop("method")


@query("f19_random_intercept_lmm_rows", None)
def f19r(spark, sf):
    return M.random_intercept_lmm(cells(spark, sf), fixed=("model", "prompt_id", "temperature"))


# The published grid of the power table.
_POWER_GRID = ([5, 10, 20, 40, 80, 164], [1, 2, 4], [1, 3, 5])


@query("f20_power_grid", None)
def f20(spark, sf):
    return M.power_grid(cells(spark, sf), 0.05, *_POWER_GRID, by=["metric_name"])


@query("h8_max_partial_eta", None)
def h8e(spark, sf):
    parts = H.nested_prefixes(cells(spark, sf), ["cell_id"], H.CONVERGENCE_SIZES, 42)
    return M.max_partial_eta(parts, "size")
