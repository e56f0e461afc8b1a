"""SQL fragments shared by the oracles. Written row-wise and by brute force on purpose."""

from __future__ import annotations

FACETS = ("model", "task_id", "prompt_id", "run_id", "temperature")


def draw(seed: str, keys: str, iteration: str, slot: str, n: str) -> str:
    key = f"concat_ws('|', {seed}, {keys + ', ' if keys else ''}{iteration}, {slot} // 2)"
    return f"(('0x' || substr(md5({key}), CAST(({slot} % 2) * 16 + 1 AS BIGINT), 15))::BIGINT % {n})"


def long_levels(view: str, facets, value: str = "metric_value", extra: str = "") -> str:
    parts = [
        f"SELECT {extra}'{f}' AS facet, CAST({f} AS VARCHAR) AS level, model AS mdl, {value} AS y FROM {view}"
        for f in facets
    ]
    return " UNION ALL ".join(parts)


def samples(view: str, facets, b: int, seed: int) -> str:
    """CTEs sums, lv, draws, scores, base, ranked, taus, samples (without WITH)."""
    offset = " ".join(f"WHEN '{f}' THEN {seed + 1000 * i}" for i, f in enumerate(facets))
    return f"""
sums AS (SELECT facet AS bootstrap_type, level, mdl AS model, sum(y) AS s, count(y) AS c
         FROM ({long_levels(view, facets)}) GROUP BY 1, 2, 3),
lv AS (SELECT bootstrap_type, level,
              row_number() OVER (PARTITION BY bootstrap_type ORDER BY md5(level), level) - 1 AS idx
       FROM (SELECT DISTINCT bootstrap_type, level FROM sums)),
sz AS (SELECT bootstrap_type, count(*) AS n, CASE bootstrap_type {offset} END AS sd FROM lv GROUP BY 1),
draws AS (SELECT bootstrap_type, it AS iteration, {draw('sd', 'bootstrap_type', 'it', 'slot', 'n')} AS idx
          FROM sz, range({b}) r(it), LATERAL (SELECT unnest(range(n)) AS slot)),
scores AS (SELECT d.bootstrap_type, CAST(d.iteration AS INTEGER) AS iteration, s.model, sum(s.s) / sum(s.c) AS score
           FROM draws d JOIN lv USING (bootstrap_type, idx) JOIN sums s USING (bootstrap_type, level) GROUP BY 1, 2, 3),
{base(view)},
ranked AS (SELECT s.*, b.rank AS base_rank, b.position,
                  {avg_rank('s.score', 'bootstrap_type, iteration')} AS rank
           FROM scores s JOIN base b USING (model)),
moves AS (SELECT bootstrap_type, iteration, max(CASE WHEN r0 <> r1 THEN 1.0 ELSE 0.0 END) AS rank_changed
          FROM (SELECT *, row_number() OVER (PARTITION BY bootstrap_type, iteration ORDER BY base_rank DESC, position) AS r0,
                       row_number() OVER (PARTITION BY bootstrap_type, iteration ORDER BY rank DESC, position) AS r1
                FROM ranked) GROUP BY 1, 2),
{taus('ranked', 'bootstrap_type, iteration', 'base_rank', 'rank')},
samples AS (SELECT bootstrap_type, iteration, model, score, rank,
                   coalesce(tau, 1.0) AS kendall_tau, CAST(rank_changed AS DOUBLE) AS rank_changed
            FROM ranked JOIN moves USING (bootstrap_type, iteration) JOIN taus USING (bootstrap_type, iteration))"""


def avg_rank(score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}round({score}, 12)"
    return (
        f"(rank() OVER ({part} ORDER BY round({score}, 12) DESC) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE)"
    )


def base(view: str, value: str = "metric_value") -> str:
    return f"""
base AS (SELECT *, row_number() OVER (ORDER BY rank, model) AS position
         FROM (SELECT *, {avg_rank('score')} AS rank
               FROM (SELECT model, avg({value}) AS score FROM {view} GROUP BY 1)))"""


def taus(source: str, by: str, x: str, y: str, name: str = "taus") -> str:
    """tau-b from all pairs; null when undefined. Groups with one member are kept."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    sel = ", ".join(f"a.{k}" for k in keys)
    return f"""
{name}_pairs AS (SELECT {sel}, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS num,
                 sum(CASE WHEN a.{x} <> b.{x} THEN 1 ELSE 0 END) AS dx,
                 sum(CASE WHEN a.{y} <> b.{y} THEN 1 ELSE 0 END) AS dy
          FROM {source} a JOIN {source} b ON {on} AND a.model < b.model GROUP BY {sel}),
{name} AS (SELECT {by}, CASE WHEN dx * dy > 0 THEN round(num / sqrt(CAST(dx AS DOUBLE) * CAST(dy AS DOUBLE)), 12) END AS tau
         FROM (SELECT DISTINCT {by} FROM {source}) LEFT JOIN {name}_pairs USING ({by}))"""


def components(view: str, facets=FACETS, by: str = "", value: str = "metric_value", name: str = "comp") -> str:
    """CTEs for variance components by the row definition, optionally per stratum column ``by``."""
    part = f"PARTITION BY {by}" if by else ""
    means = ", ".join(
        f"avg({value}) OVER (PARTITION BY {by + ', ' if by else ''}{f}) - avg({value}) OVER ({part}) AS d_{f}" for f in facets
    )
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rows = " UNION ALL ".join(
        f"SELECT {b}'{f}' AS component, v_{f} AS variance, n FROM {name}_wide" for f in (*facets, "residual", "total")
    )
    # a small epsilon-free variance: effects average to zero, so the sum of squares is enough
    ss = ", ".join(f"sum(d_{f} * d_{f}) / greatest(count(*) - 1, 1) AS v_{f}" for f in facets)
    left = f"(y - m{''.join(f' - d_{f}' for f in facets)})"
    return f"""
{name}_rows AS (SELECT {b}{value} AS y, avg({value}) OVER ({part}) AS m, {means} FROM {view}),
{name}_wide AS (SELECT {b}{ss}, sum({left} * {left}) / greatest(count(*) - 1, 1) AS v_residual,
                coalesce(var_samp(y), 0) AS v_total, count(*) AS n FROM {name}_rows {group}),
{name} AS ({rows})"""


def row_bootstrap(view: str, ids: str, b: int, seed: int, by: str = "", value: str = "metric_value", name: str = "boot") -> str:
    """CTEs redrawing every row of each group: {name}_stats(by…, iteration, stat)."""
    key = f"md5(concat_ws('|', {ids}))"
    part = f"PARTITION BY {by}" if by else ""
    b_ = f"{by}, " if by else ""
    using = f"{by}, idx" if by else "idx"
    return f"""
{name}_rows AS (SELECT {b_}{value} AS y, row_number() OVER ({part} ORDER BY {key}, {ids}) - 1 AS idx FROM {view}),
{name}_sz AS (SELECT {b_}count(*) AS n FROM {name}_rows {'GROUP BY ' + by if by else ''}),
{name}_draws AS (SELECT {b_}it AS iteration, {draw(str(seed), by, 'it', 'slot', 'n')} AS idx
          FROM {name}_sz, range({b}) r(it), LATERAL (SELECT unnest(range(n)) AS slot)),
{name}_stats AS (SELECT {b_}iteration, avg(y) AS stat FROM {name}_draws JOIN {name}_rows USING ({using}) GROUP BY {b_}iteration)"""


def subset_scores(view: str, sizes, s: int, seed: int) -> str:
    """CTEs mt, ref, picks, sub(n_requested, subset_index, n_tasks, model, score)."""
    listed = ", ".join(str(x) for x in sizes)
    return f"""
mt AS (SELECT model, task_id, avg(metric_value) AS mean FROM {view} GROUP BY 1, 2),
ref AS (SELECT *, row_number() OVER (ORDER BY full_rank, model) AS position
        FROM (SELECT model, full_score, {avg_rank('full_score')} AS full_rank
              FROM (SELECT model, avg(mean) AS full_score FROM mt GROUP BY 1))),
picks AS (SELECT * FROM (SELECT task_id, n_requested, subset_index,
             row_number() OVER (PARTITION BY n_requested, subset_index
                ORDER BY md5(concat_ws('|', {seed}, n_requested, subset_index, task_id)), task_id) AS r
          FROM (SELECT DISTINCT task_id FROM mt), (SELECT unnest([{listed}]) AS n_requested), range({s}) q(subset_index))
          WHERE r <= n_requested),
sub AS (SELECT p.n_requested, CAST(p.subset_index AS INTEGER) AS subset_index,
               CAST(count(DISTINCT p.task_id) AS INTEGER) AS n_tasks_model, mt.model, avg(mt.mean) AS score
        FROM picks p JOIN mt USING (task_id) GROUP BY 1, 2, 4),
sizes AS (SELECT n_requested, CAST(subset_index AS INTEGER) AS subset_index, CAST(count(*) AS INTEGER) AS n_tasks FROM picks GROUP BY 1, 2)"""


def f_tail(relation: str) -> str:
    """term and p_value = P(F > f_stat) for a relation of term, f_stat, df and dfe, by the continued fraction of the incomplete beta function."""
    step = "1 + m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)) / (1 - (p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)) / h)"
    return f"""SELECT term, CASE WHEN f_stat <= 0 THEN 1 WHEN swapped THEN 1 - part ELSE part END AS p_value FROM (
SELECT *, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(t) + q * ln(1 - t)) / p
  / (1 - (p + q) * t / (p + 1) / list_reduce(CAST(range(2000, 0, -1) AS DOUBLE[]), lambda h, m: {step}, CAST(1 AS DOUBLE))) AS part
FROM (SELECT *, CASE WHEN swapped THEN b ELSE a END AS p, CASE WHEN swapped THEN a ELSE b END AS q, CASE WHEN swapped THEN 1 - x ELSE x END AS t
FROM (SELECT *, x > (a + 1) / (a + b + 2) AS swapped
FROM (SELECT term, f_stat, CAST(dfe AS DOUBLE) / 2 AS a, CAST(df AS DOUBLE) / 2 AS b, CAST(dfe AS DOUBLE) / (dfe + df * f_stat) AS x FROM {relation}))))"""


def normal_tails(z: str) -> str:
    """P(|N(0, 1)| > |z|), by the series of the error function, whose terms are all positive; nothing is left beyond 10."""
    return f"""CASE WHEN abs({z}) > 10 THEN 0 ELSE 1 - sqrt(2 / pi()) * exp(-0.5 * ({z}) ** 2) * abs({z})
  * list_reduce(CAST(range(400, 0, -1) AS DOUBLE[]), lambda h, m: 1 + ({z}) ** 2 / (2 * m + 1) * h, CAST(1 AS DOUBLE)) END"""
