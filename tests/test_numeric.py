"""Regression results against plain linear algebra on the rows, and tail functions against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import draws, tail_columns, tails
from gaugeframe.operators import regression as M
from gaugeframe.operators import resampling as R
from gaugeframe.operators import variance as V


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(700):
        m, t, p = rng.integers(3), rng.integers(12), rng.choice(3, p=[0.6, 0.3, 0.1])
        score = 0.3 * m + 0.1 * np.sin(t) + 0.05 * p + rng.normal(0, 0.4)
        out.append((f"m{m}", f"t{t}", f"p{p}", int(rng.integers(2)), float(rng.choice([0.0, 0.2])), "pass_at_1", float(score)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(
        rows, "model string, task_id string, prompt_id string, run_id int, temperature double, metric_name string, metric_value double"
    ).cache()


def dummies(rows, index, drop=True):
    levels = sorted({r[index] for r in rows})
    return np.array([[float(r[index] == l) for l in levels[1 if drop else 0:]] for r in rows])


def sse(x, y):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ beta) ** 2).sum())


FACTORS = {"model": 0, "task_id": 1, "prompt_id": 2, "run_id": 3, "temperature": 4}


def test_anova_against_least_squares(frame, rows):
    y = np.array([r[6] for r in rows])
    one = np.ones((len(rows), 1))
    blocks = {f: dummies(rows, i) for f, i in FACTORS.items()}
    full = np.hstack([one, *blocks.values()])
    error = sse(full, y)
    got = {r.term: r for r in M.anova(frame, 2).collect()}
    for f in FACTORS:
        reduced = sse(np.hstack([one, *[b for g, b in blocks.items() if g != f]]), y)
        assert got[f].sum_sq == pytest.approx(reduced - error, rel=1e-8)
        assert got[f].df == blocks[f].shape[1]
        assert got[f].partial_eta_squared == pytest.approx((reduced - error) / reduced, rel=1e-8)
        assert 0.0 <= got[f].p_value <= 1.0
    third = {r.term: r for r in M.anova(frame, 3).collect()}
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    want = beta[0] ** 2 / np.linalg.inv(full.T @ full)[0, 0]
    assert third["Intercept"].sum_sq == pytest.approx(want, rel=1e-8) and third["Intercept"].is_intercept
    assert third["model"].sum_sq == pytest.approx(got["model"].sum_sq)


def test_anova_without_factors(frame):
    flat = frame.select(*[F.lit("x").alias(c) for c in ("model", "task_id", "prompt_id")], "metric_value")
    assert M.anova(flat).count() == 0


def test_sequential_shares_against_projection(frame, rows):
    y = np.array([r[6] for r in rows])
    r = y - y.mean()
    want = {}
    for f in V.FACETS:
        d = dummies(rows, FACTORS[f], drop=False)
        means = (d.T @ r) / d.sum(axis=0)
        before = (r**2).sum()
        r = r - d @ means
        want[f] = before - (r**2).sum()
    got = {x.component: x.ss for x in V.type1_shares(frame).collect()}
    for f, ss in want.items():
        assert got[f] == pytest.approx(ss, rel=1e-9)


@pytest.mark.parametrize("kind", [2, 3])
def test_anova_by_gradients_equals_the_matrix(frame, monkeypatch, kind):
    want = M.anova(frame, kind).collect()
    monkeypatch.setattr(M, "MAX_COEFFICIENTS", 3)
    got = {r.term: r for r in M.anova(frame, kind).collect()}
    assert len(got) == len(want)
    for r in want:
        for c in ("sum_sq", "df", "f_stat", "p_value", "partial_eta_squared", "omega_squared"):
            assert got[r.term][c] == pytest.approx(r[c], rel=1e-7, abs=1e-10), (r.term, c)


def test_anova_of_sparse_and_disconnected_levels(spark, monkeypatch):
    """Some hundred tasks and prompts, each task under few prompts; the last ten tasks share no prompt with the others."""
    rng = np.random.default_rng(8)
    tasks, prompts = rng.normal(size=310), rng.normal(size=260)
    rows = [(f"m{i % 2}", t, p) for t in range(300) for i, p in enumerate(rng.choice(250, 4, replace=False))]
    rows += [(f"m{i % 2}", t, p) for t in range(300, 310) for i, p in enumerate(range(250, 260))]
    data = [(m, f"t{t}", f"p{p}", float(tasks[t] + prompts[p] + (m == "m1") + rng.normal())) for m, t, p in rows]
    monkeypatch.setattr(M, "MAX_COEFFICIENTS", 100)
    got = {r.term: r for r in M.anova(spark.createDataFrame(data, "model string, task_id string, prompt_id string, metric_value double"), 2).collect()}
    y = np.array([d[3] for d in data])
    parts = {"model": dummies(data, 0, drop=False), "task_id": dummies(data, 1, drop=False), "prompt_id": dummies(data, 2, drop=False)}
    whole = np.hstack(list(parts.values()))
    full, rank = sse(whole, y), np.linalg.matrix_rank(whole)
    assert len(parts["task_id"].T) == 310
    for f in parts:
        rest = np.hstack([v for k, v in parts.items() if k != f])
        assert got[f].sum_sq == pytest.approx(sse(rest, y) - full, rel=1e-7)
        df = rank - np.linalg.matrix_rank(rest)
        assert got[f].df == df
        assert got[f].f_stat == pytest.approx((sse(rest, y) - full) / df / (full / (len(y) - rank)), rel=1e-7)


def test_binomial_and_cluster_errors(frame, rows):
    binary = frame.withColumn("metric_value", (F.col("metric_value") > 0.4).cast("double"))
    pf = V.pass_fail_frame(binary)
    fit = M.binomial_glm(pf)
    y = np.array([float(r[6] > 0.4) for r in rows])
    x = np.hstack([np.ones((len(rows), 1)), dummies(rows, 0), dummies(rows, 2), np.array([[r[4]] for r in rows])])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
    assert fit.terms == ["const", "model_id_m1", "model_id_m2", "prompt_variant_id_p1", "prompt_variant_id_p2", "temperature"]
    assert np.allclose(fit.estimates, beta, atol=1e-6)
    assert np.allclose(fit.errors, np.sqrt(np.diag(bread)), atol=1e-6)
    groups = np.array([r[1] for r in rows])
    u = np.array([(x[groups == g] * (y - p)[groups == g, None]).sum(axis=0) for g in sorted(set(groups))])
    n, k, g = len(rows), x.shape[1], len(u)
    want = np.sqrt(np.diag(bread @ (u.T @ u) @ bread) * g / (g - 1) * (n - 1) / (n - k))
    got = {r.term: r.std_error for r in M.cluster_robust_se(fit).collect()}
    assert np.allclose([got[t] for t in fit.terms], want, rtol=1e-5)


def test_rows_of_other_metrics_stay_out(frame):
    other = frame.withColumns({"metric_name": F.lit("length"), "metric_value": F.lit(1.0)})
    counts = lambda df: sorted(V.pass_fail_frame(df).groupBy("pass_fail").count().collect())
    assert counts(frame.union(other)) == counts(frame)
    assert V.pass_fail_frame(other).count() == 0


def test_separation_is_flagged(spark):
    data = [("a", "p", "t", 0, 0.0, "pass_at_1", 1.0)] * 5 + [("b", "p", "t", 0, 0.0, "pass_at_1", float(i % 2)) for i in range(6)]
    df = spark.createDataFrame(
        data, "model string, prompt_id string, task_id string, run_id int, temperature double, metric_name string, metric_value double"
    )
    pf = V.pass_fail_frame(df)
    assert [r.level for r in M.separated_levels(M.outcome_cells(pf)).filter("factor = 'model_id'").collect()] == ["a"]
    assert not any(r.include_in_publication for r in M.binomial_glm(pf).coefficients(spark).collect())


def test_mixed_model_against_direct_reml(frame, rows):
    y = np.array([r[6] for r in rows])
    x = np.hstack([np.ones((len(rows), 1)), dummies(rows, 0), dummies(rows, 2)])
    z = dummies(rows, 1, drop=False)
    n, k = x.shape

    def criterion(ratio):
        v = np.eye(n) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        beta = np.linalg.solve(a, x.T @ vi @ y)
        r = y - x @ beta
        rss = r @ vi @ r
        return (n - k) * np.log(rss / (n - k)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, rss / (n - k)

    got = {r.term: r for r in M.random_intercept_lmm(frame, fixed=("model", "prompt_id")).collect()}
    ratio = got["task_id"].estimate / got["residual"].estimate
    best = criterion(max(ratio, 1e-12))
    assert got["residual"].estimate == pytest.approx(best[2], rel=1e-6)
    assert got["model_m2"].estimate == pytest.approx(best[1][2], rel=1e-6)
    for other in (ratio * 0.9, ratio * 1.1, 1e-12):
        assert criterion(max(other, 1e-12))[0] >= best[0] - 1e-9


def test_single_group_falls_back(frame):
    one = frame.withColumn("task_id", F.lit("t"))
    methods = {r.method for r in M.random_intercept_lmm(one).collect()}
    assert methods == {"anova_fallback"}


def test_tail_values():
    assert tails.t_sf(2.0, 10) == pytest.approx(0.03669401738537018, rel=1e-9)
    assert tails.t_sf(-2.0, 10) == pytest.approx(1 - 0.03669401738537018, rel=1e-9)
    assert tails.f_sf(4.0, 2, 12) == pytest.approx((1 + 4.0 * 2 / 12) ** -6, rel=1e-9)
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert tails.t_upper(0.025, np.array([10.0]))[0] == pytest.approx(2.228138851964939, rel=1e-8)
    assert tails.noncentral_t_power(0.5, 64.0) == pytest.approx(0.8014596, abs=1e-6)


def test_power_grows(frame):
    def power(effect):
        rows = M.power_grid(frame, effect, [5, 50], [1], [1, 4]).collect()
        return {(r.n_tasks, r.n_runs): r.power for r in rows}

    small, large = power(0.1), power(0.4)
    assert small[(5, 1)] < small[(50, 1)] < small[(50, 4)] <= 1.0
    assert all(large[k] > small[k] for k in small)


def test_power_needs_two_cells(frame):
    assert M.power_grid(frame, 0.4, [1], [1], [1]).first().power == 0.0


def component_values(df, **kw):
    return {r["component"]: (r["variance"], r["n"]) for r in V.variance_components(df, **kw).collect()}


def test_an_offset_changes_no_variance(frame):
    plain, moved = component_values(frame), component_values(frame.withColumn("metric_value", F.col("metric_value") + 1e9))
    assert plain.keys() == moved.keys()
    for name, (v, n) in plain.items():
        assert moved[name][1] == n and moved[name][0] == pytest.approx(v, rel=1e-4, abs=1e-5)


def test_a_null_facet_keeps_its_rows(frame):
    gaps = frame.withColumn("prompt_id", F.when(F.col("prompt_id") != "p1", F.col("prompt_id")))
    plain, found = component_values(frame), component_values(gaps)
    assert {n for _, n in found.values()} == {n for _, n in plain.values()}
    assert found["total"] == pytest.approx(plain["total"]) and found["model"] == pytest.approx(plain["model"])


def test_leave_one_out_ignores_an_offset(frame):
    from gaugeframe.operators import resampling as H

    def table(df):
        return {(r[0], r[1]): [r[c] for c in ("model_variance_change", "prompt_variance_change", "task_variance_change", "residual_variance_change")] for r in H.leave_one_out(df).collect()}

    plain, moved = table(frame), table(frame.withColumn("metric_value", F.col("metric_value") + 1e6))
    assert plain.keys() == moved.keys()
    for key, values in plain.items():
        assert moved[key] == pytest.approx(values, abs=1e-6)


def test_counts_in_many_bins_keep_the_law(spark, monkeypatch):
    """Means redrawn from value counts: the same law with one bin of values as with forty, and that of resampled means."""
    rng = np.random.default_rng(12)
    data = [("a", float(v)) for v in rng.exponential(size=1500)] + [("a", 9.0)] * 500 + [("b", float(v)) for v in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(data, "model string, score double")
    tables = {}
    for size in (10_000, 40):
        monkeypatch.setattr(R, "BIN_VALUES", size)
        drawn = R.resampled_means_by_counts(df, "score", ["model"], 1500, seed=3)
        tables[size] = drawn.toPandas()
        again = R.resampled_means_by_counts(df, "score", ["model"], 1500, seed=3).toPandas()
        keyed = lambda t: t.set_index(["model", "iteration"]).sort_index()["stat"]
        assert np.allclose(keyed(tables[size]), keyed(again), rtol=1e-12)
    for name in ("a", "b"):
        y = np.array([v for m, v in data if m == name])
        for t in tables.values():
            stats = t.loc[t.model == name, "stat"]
            assert len(stats) == 1500
            assert stats.mean() == pytest.approx(y.mean(), abs=4 * y.std() / np.sqrt(len(y) * 1500))
            assert stats.std() == pytest.approx(y.std() / np.sqrt(len(y)), rel=0.1)
    whole = R.resampled_means_by_counts(df, "score", n_bootstrap=50)
    assert whole.columns == ["iteration", "stat"] and whole.count() == 50


def test_row_bootstrap_broadcasts_no_draws(spark, monkeypatch):
    """Few rows: their blocks are broadcast; many rows: draws and blocks meet in a shuffle. The results agree."""
    df = spark.createDataFrame([(f"m{i % 2}", i, float(i * i % 97)) for i in range(9000)], "model string, id int, score double")
    plans, found = [], []
    for few in (1_000_000, 10):
        monkeypatch.setattr(R, "LOCAL_ROWS", few)
        drawn = R.bootstrap_statistics(df, "score", ["id"], ["model"], 20)
        plans.append(drawn._jdf.queryExecution().executedPlan().toString())
        found.append(sorted(map(tuple, drawn.collect())))
    assert found[0] == found[1] and len(found[0]) == 40
    assert "BroadcastHashJoin [model" in plans[0] and "BuildRight" in plans[0]
    assert "BroadcastHashJoin" not in plans[1].split("_values")[0]


def test_leave_one_out_reads_rows_once(spark, frame):
    """Its level sets come from one reading of the rows, few sets at a time, and agree with those taken from rows."""
    seen = spark.sparkContext.accumulator(0)

    def look(score):
        seen.add(1)
        return score

    n = frame.count()
    R.leave_one_out(frame.withColumn("metric_value", F.udf(look, "double").asNondeterministic()("metric_value"))).collect()
    assert seen.value == n
    odd = frame.withColumn("task_id", F.when(F.col("task_id") != "t3", F.col("task_id"))).withColumn("metric_value", F.col("metric_value") + 1e6)
    depths, keys = (0, 1, 2, 3), ["f0", "l0", "f1", "l1", "f2", "l2"]
    facets = V.present_facets(odd)
    want = {tuple(r[k] for k in keys): r for r in V.level_sets(odd, facets, depths).collect()}
    got = {tuple(r[k] for k in keys): r for r in V.centred_level_sets(odd, facets, depths).collect()}
    assert got.keys() == want.keys() and len(want) > 500
    whole = want[(None,) * 6].mean
    for k, r in want.items():
        assert got[k].n == r.n and abs(got[k].mean - (r.mean - whole)) < 1e-8
        assert (got[k].var is None) == (r.var is None) and (r.var is None or abs(got[k].var - r.var) < 1e-8)


def test_packed_draws_are_the_draws(spark, monkeypatch):
    """Draws that go to their blocks take about a byte each, and are those of ``index_draws``, whatever a run holds."""
    sizes = spark.createDataFrame([("a", 30_001), ("b", 1), ("c", 700)], "k string, n bigint")
    want = sorted(map(tuple, draws.index_draws(sizes, ["k"], 3, 7).collect()))
    for run in (draws.RUN, 4096):
        monkeypatch.setattr(draws, "RUN", run)
        packed = draws.packed_draws(sizes, ["k"], 3, 7, 10).collect()
        got = [(r.k, r.iteration, (r._block << 10) + int(at)) for r in packed for at in draws.unpack_steps(bytes(r._steps))]
        assert sorted(got) == want
        assert sum(len(r._steps) for r in packed) < 1.5 * len(want)
    for at in ([0], [255], [254, 254, 510, 5000], [0, 0, 255, 32767]):
        assert draws.unpack_steps(draws.pack_steps(np.array(at))).tolist() == at


def test_f_tail_as_a_column(spark):
    rows = [(f, a, b) for f in (0.01, 0.5, 1.0, 3.0, 200.0) for a in (1.0, 2.0, 9.0, 200.0) for b in (1.0, 2.0, 7.0, 1000.0, 60000.0)]
    columns = "f double, a double, b double"
    tail = tail_columns.f_tail(F.col("f"), F.col("a"), F.col("b"))
    for r in spark.createDataFrame(rows, columns).withColumn("p", tail).collect():
        assert abs(r.p - float(tails.f_sf(r.f, r.a, r.b))) < 1e-10
    # F(2, n) has the tail (1 + 2 f / n) ** (-n / 2), for any number of rows
    for r in spark.createDataFrame([(f, 2.0, n) for f in (0.3, 2.5) for n in (4.0, 1e6, 1e9)], columns).withColumn("p", tail).collect():
        assert np.isclose(r.p, np.exp(-r.b / 2 * np.log1p(2 * r.f / r.b)), rtol=1e-9 if r.b < 1e9 else 1e-8, atol=0)
    odd = spark.createDataFrame([(0.0, 1.0, 5.0), (-1.0, 1.0, 5.0), (None, 1.0, 5.0), (1.0, 1.0, None)], columns).withColumn("p", tail).collect()
    assert [r.p for r in odd] == [1.0, 1.0, None, None]
