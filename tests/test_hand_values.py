"""Small frames with values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import text as X
from gaugeframe.functions.draws import dense_index, index_draws
from gaugeframe.functions.order_stats import exact_quantiles
from gaugeframe.operators import describe as D
from gaugeframe.operators import design as B
from gaugeframe.operators import log as C
from gaugeframe.operators import ranking as R
from gaugeframe.operators import resampling as H
from gaugeframe.operators import scoring as S
from gaugeframe.operators import variance as V
from gaugeframe.sources import frame as A
from gaugeframe.sources import results as RS
from gaugeframe.sources import tasks as K


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "model string, task_id string, prompt_id string, run_id int, temperature double, metric_name string, metric_value double"
    )


def crossed(spark, base, noise=lambda m, t, p, r: 0.0, tasks=4, prompts=2, runs=3):
    rows = [
        (m, f"t{t}", f"p{p}", r, 0.0, "score", base[m] + noise(m, t, p, r))
        for m in base for t in range(tasks) for p in range(prompts) for r in range(runs)
    ]
    return frame(spark, rows)


def test_aliases_and_defaults(spark):
    raw = spark.createDataFrame([("a", "t1", "p1", 3, 0.5)], "model_id string, task string, prompt_variant_id string, run_index int, score double")
    row = A.prepare_results(raw).first()
    assert (row.model, row.task_id, row.prompt_id, row.run_id, row.metric_value) == ("a", "t1", "p1", 3, 0.5)
    assert (row.metric_name, row.temperature) == ("score", 0.0)


def test_metric_filter_and_missing_columns(spark):
    raw = spark.createDataFrame([("a", "t", "x", 1.0), ("a", "t", "y", 0.0)], "model string, task_id string, metric_name string, metric_value double")
    assert [r.metric_value for r in A.prepare_results(raw, "y").collect()] == [0.0]
    with pytest.raises(ValueError):
        A.prepare_results(raw.drop("task_id"))


def test_scores_map_drops_rows_without_the_metric(spark):
    raw = spark.createDataFrame(
        [("a", "t1", {"pass_at_1": 1.0}), ("a", "t2", {"other": 0.5})], "model_id string, task_id string, scores map<string,double>"
    )
    rows = A.prepare_results(raw, "pass_at_1").collect()
    assert [(r.task_id, r.metric_value) for r in rows] == [("t1", 1.0)]


def test_strict_analysis_needs_the_table(spark):
    with pytest.raises(FileNotFoundError):
        A.analysis_frame(None, None)


def test_unknown_format():
    with pytest.raises(ValueError):
        RS.format_of("results.xlsx")


def test_cell_id_is_python_sha256(spark):
    df = spark.createDataFrame([("m", "t", "p", 0.2, 3)], "model_id string, task_id string, prompt_variant_id string, temperature double, run_index int")
    row = B.with_cell_id(df, 42).first()
    assert row.seed == 45
    assert row.cell_id == hashlib.sha256(b"m|t|p|0.200000|3|45").hexdigest()


def test_default_prompt(spark):
    one = spark.createDataFrame([("m", 0)], "model_id string, position int")
    temps = spark.createDataFrame([(0.0, 0)], "temperature double, position int")
    tasks = spark.createDataFrame([("t1", 0), ("t2", 1)], "task_id string, position int")
    rows = B.expand_design(one, temps, tasks, n_runs=2).orderBy("cell_order").collect()
    assert [(r.run_index, r.task_id) for r in rows] == [(0, "t1"), (0, "t2"), (1, "t1"), (1, "t2")]
    assert {r.template for r in rows} == {"{input}"}


def test_unknown_placeholder_is_an_error_row(spark):
    tasks = spark.createDataFrame([("t", "{who}")], "task_id string, input string")
    prompts = spark.createDataFrame([("ok", "{input}!"), ("bad", "{input}{who}")], "prompt_variant_id string, template string")
    good, bad = B.render_prompts(tasks, prompts)
    assert [r.rendered_prompt for r in good.collect()] == ["{who}!"]
    assert [(r.prompt_variant_id, r.unknown) for r in bad.collect()] == [("bad", ["who"])]


def test_draws_follow_md5(spark):
    groups = spark.createDataFrame([("g", 5)], "k string, n bigint")
    got = sorted((r.iteration, r.idx) for r in index_draws(groups, ["k"], 3, 7).collect())
    want = []
    for it in range(3):
        for slot in range(5):
            h = hashlib.md5(f"7|g|{it}|{slot // 2}".encode()).hexdigest()
            want.append((it, int(h[(slot % 2) * 16 : (slot % 2) * 16 + 15], 16) % 5))
    assert got == sorted(want)


def test_draws_cross_chunks(spark):
    groups = spark.createDataFrame([(9001,)], "n bigint")
    rows = index_draws(groups, [], 2, 1).groupBy("iteration").agg(F.count("idx").alias("c"), F.max("idx").alias("m")).collect()
    assert {(r.iteration, r.c) for r in rows} == {(0, 9001), (1, 9001)} and all(r.m < 9001 for r in rows)


def test_dense_index_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    counts = dense_index(df, ["k"], ["g"]).groupBy("g").agg(F.countDistinct("idx").alias("d"), F.max("idx").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.n == r.m + 1 for r in counts)


def test_exact_quantiles_with_outlier(spark):
    values = [1.0, 2.0, 2.0, 3.0, 1e12]
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double").groupBy("g", "value").agg(F.count("*").alias("c"))
    row = exact_quantiles(df, ["g"], {"lo": 0.25, "mid": 0.5, "hi": 0.9}, moments=True).first()
    assert (row.lo, row.mid) == (2.0, 2.0)
    assert row.hi == pytest.approx(3.0 + 0.6 * (1e12 - 3.0))
    assert row["count"] == 5


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.7), ("c", 0.8), ("d", 0.7)], "model string, score double")
    assert {r.model: r["rank"] for r in R.with_rank(df).collect()} == {"a": 1.0, "c": 2.0, "b": 3.5, "d": 3.5}


@pytest.mark.parametrize(
    ("x", "y", "tau"),
    [
        ([1, 2, 3, 4], [1, 2, 3, 4], 1.0),
        ([1, 2, 3, 4], [4, 3, 2, 1], -1.0),
        ([1, 2, 3, 4, 5, 6], [1, 2.5, 2.5, 4, 6, 5], (13 - 1) / (15 * 14) ** 0.5),
        ([1.5, 1.5, 3], [1, 2, 3], 2 / (2 * 3) ** 0.5),
        ([2, 2, 2], [1, 2, 3], 1.0),
        ([1], [1], 1.0),
    ],
)
def test_kendall_tau(spark, x, y, tau):
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double")
    assert R.kendall_tau(df, "x", "y", ["g"]).first().kendall_tau == pytest.approx(tau, abs=1e-9)


def test_kendall_tau_against_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    groups = {g: [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(37)] for g in range(5)}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, v in groups.items() for a, b in v], "g int, x double, y double")
    got = {r.g: r.kendall_tau for r in R.kendall_tau(df, "x", "y", ["g"]).collect()}
    for g, v in groups.items():
        num = dx = dy = 0
        for (a, b), (c, d) in itertools.combinations(v, 2):
            sx, sy = (a > c) - (a < c), (b > d) - (b < d)
            num, dx, dy = num + sx * sy, dx + abs(sx), dy + abs(sy)
        assert got[g] == pytest.approx(num / (dx * dy) ** 0.5, abs=1e-9)


def test_rank_probabilities(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0), ("a", 1.5, 1), ("b", 1.5, 1)], "model string, rank double, iteration int")
    got = {(r.model, r["rank"]): r.probability for r in R.rank_probabilities(df).collect()}
    assert got == {("a", 1.0): 0.5, ("a", 1.5): 0.5, ("a", 2.0): 0.0, ("b", 1.0): 0.0, ("b", 1.5): 0.5, ("b", 2.0): 0.5}


def test_stable_models_are_less_fragile(spark):
    stable = crossed(spark, {"a": 0.9, "b": 0.5, "c": 0.1}, lambda m, t, p, r: 0.001 * t)
    # one task decides between the models
    unstable = crossed(spark, {"a": 0.51, "b": 0.50, "c": 0.49}, lambda m, t, p, r: 0.4 * ((t * 7 + ord(m) * 3) % 5 - 2))

    def index(df):
        rows = R.fragility_summary(R.bootstrap_all_facets(df, n_bootstrap=50), "score").collect()
        return {r.bootstrap_type: r.fragility_index for r in rows}

    assert index(stable)["overall"] == 0.0
    assert index(unstable)["task_id"] > 0.0


def test_components_of_three_models(spark):
    df = crossed(spark, {"a": 0.9, "b": 0.85, "c": 0.8}, lambda m, t, p, r: 0.001 * r, tasks=2)
    got = {r.component: r.variance for r in V.variance_components(df).collect()}
    n = 36
    assert got["model"] == pytest.approx(12 * 2 * 0.05**2 / (n - 1))
    assert got["run_id"] == pytest.approx(12 * 2 * 0.001**2 / (n - 1))
    assert got["residual"] == pytest.approx(0.0, abs=1e-12)
    assert got["model"] + got["run_id"] == pytest.approx(got["total"])
    assert got["temperature"] == pytest.approx(0.0, abs=1e-12)
    assert got["prompt_id"] == pytest.approx(0.0, abs=1e-12)


def test_shares_sum_to_one_hundred(spark):
    df = crossed(spark, {"a": 0.9, "b": 0.2}, lambda m, t, p, r: 0.07 * ((t * 5 + p * 3 + r * 2) % 7))
    for table in (V.type1_shares(df), V.interaction_shares(df)):
        assert table.agg(F.sum("pct_ss")).first()[0] == pytest.approx(100.0)


def test_more_replication_helps(spark):
    df = crossed(spark, {"a": 0.9, "b": 0.2}, lambda m, t, p, r: 0.07 * ((t * 5 + p * 3 + r * 2) % 7))
    rows = V.d_study(df, [5, 50], [1, 4], [1]).collect()
    by = {(r.n_tasks, r.n_prompts): r for r in rows}
    assert by[(50, 1)].expected_observed_variance < by[(5, 1)].expected_observed_variance
    assert by[(50, 4)].g_rel > by[(5, 1)].g_rel
    assert len({round(r.g_coefficient, 12) for r in rows}) == 1


def test_cliffs_delta_sign(spark):
    df = frame(spark, [("a", "t", "p", i, 0.0, "s", v) for i, v in enumerate([3.0, 4.0])] + [("b", "t", "p", i, 0.0, "s", v) for i, v in enumerate([1.0, 3.0])])
    row = V.cliffs_delta(df, ["model"]).first()
    assert row.cliffs_delta == pytest.approx(-0.75)
    assert row.cliffs_delta_high_minus_low == pytest.approx(0.75)


LOG = "cell_id string, status string, executed_at timestamp, seq bigint"


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, status string, at string, seq bigint").select(
        "cell_id", "status", F.col("at").cast("timestamp").alias("executed_at"), "seq"
    )


def test_coverage(spark):
    log = log_rows(
        spark,
        [("c1", "failed", "2024-01-01", 1), ("c1", "completed", "2024-01-02", 2), ("c2", "completed", "2024-01-01", 3), ("x", "failed", "2024-01-01", 4)],
    )
    expected = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "cell_id string")
    marks = spark.createDataFrame([("c1", "completed"), ("c2", "completed"), ("x", "failed")], "cell_id string, status string")
    row = C.coverage_counts(expected, log, marks).first().asDict()
    assert row == {
        "expected_cells": 4, "checkpoint_completed_cells": 2, "checkpoint_failed_cells": 1, "result_cells": 3,
        "result_completed_cells": 2, "result_failed_cells": 1, "missing_cell_ids": 2, "unexpected_cell_ids": 1, "duplicate_cell_ids": 1,
    }
    assert sorted(r.cell_id for r in C.missing_cells(expected, marks).collect()) == ["c3", "c4"]


def test_later_line_wins_equal_times(spark):
    log = log_rows(spark, [("c", "completed", "2024-01-01", 1), ("c", "failed", "2024-01-01", 2), ("c", "completed", "2023-12-31", 3)])
    assert C.latest_by_cell(log).first().status == "failed"
    assert C.completed_latest(log).first().seq == 1


def test_recovery_actions(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cell_id string")
    before = log_rows(spark, [("a", "completed", "2024-01-01", 1), ("b", "failed", "2024-01-01", 2)])
    after = log_rows(spark, [("b", "completed", "2024-01-02", 3), ("c", "failed", "2024-01-02", 4)])
    got = {r.cell_id: r.action for r in C.recovery_audit(work, before, after).collect()}
    assert got == {"a": "skip_already_completed", "b": "recovered", "c": "retry_failed", "d": "not_retried"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a = C.table_fingerprint(df).first()
    b = C.table_fingerprint(df.orderBy(F.desc("id")).repartition(7), a.fingerprint).first()
    assert b.matches and a.n_rows == 100
    assert C.table_fingerprint(df.filter("id < 99")).first().fingerprint != a.fingerprint


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("Here:\n```python\ndef f():\n    return 1\n```\nend", "def f():\n    return 1"),
        ("x\n```PYTHON\na = 1\n```", "a = 1"),
        ("x\n```\nb = 2\n```", "b = 2"),
        ("sure! def g(): pass", "def g(): pass"),
        ("  plain text ", "plain text"),
        ("   ", ""),
        (" x ", "x"),
    ],
)
def test_extract_code(spark, text, code):
    row = spark.createDataFrame([(text,)], "t string").select(X.extract_code(F.col("t")).alias("c")).first()
    assert row.c == code


def test_normalize_code(spark):
    text = "\n\ndef f():  \r\n    x = 1\x0b\n\n\n\n    return x \n\n"
    row = spark.createDataFrame([(text,)], "t string").select(X.normalize_code(F.col("t")).alias("c")).first()
    assert row.c == "def f():\n    x = 1\n\n    return x"


def test_text_metrics(spark):
    df = spark.createDataFrame([("The  cat sat", "the cat ran"), ("", "x"), ("a", None)], "p string, r string")
    p, r = F.col("p"), F.col("r")
    rows = df.select(X.exact_match(p, r).alias("e"), X.contains_expected(p, r).alias("c"), X.lexical_overlap(p, r).alias("f"), X.word_count(p).alias("n")).collect()
    assert rows[0].f == pytest.approx(2 / 3) and rows[0].n == 3
    assert [x.e for x in rows] == [0.0, 0.0, 0.0] and rows[1].n == 0 and rows[2].f == 0.0


def test_unicode_white_space_equals_python(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    got = {r.c: r.n for r in df.select("c", X.normalize_text(F.col("t")).alias("n")).collect()}
    assert [c for c in points if (got[c] == "a b") != chr(c).isspace()] == []


def test_syntax_check(spark):
    df = spark.createDataFrame([("```python\nx = 1\n```",), ("def broken(:",), ("",), ("x = '\x00'",)], "t string")
    assert [r.s for r in df.select(X.syntax_check(F.col("t")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_bug_removed(spark):
    df = spark.createDataFrame([("bug", "bug", "fix"), ("fix ", "bug", "fix"), ("other", "bug", "fix"), (" ", "bug", "fix")], "p string, b string, f string")
    got = [r.s for r in df.select(X.bug_removed(F.col("p"), F.col("b"), F.col("f")).alias("s")).collect()]
    assert got == [0.0, 1.0, 0.5, 0.0]


def test_unsupported_metric(spark):
    with pytest.raises(ValueError):
        S.metric_struct("bleu")


def test_task_lines(spark):
    good = '{"task_id": "a-1", "domain": "bug_repair", "input": "x", "language": " Python ", "source_benchmark": "s", "tags": [" t ", ""], "tests": []}'
    lines = [good, "", "{oops", "[1]", good.replace("a-1", "1a"), good.replace('"x"', '" "')]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "n int, value string")
    got = {r.n: r for r in K.parse_task_lines(df).collect()}
    assert sorted(got) == [0, 2, 3, 4, 5]
    assert got[0].errors == [] and got[0].language == "python" and got[0].tags == ["t"] and got[0].tests is None
    assert [got[i].errors for i in (2, 3, 4, 5)] == [["invalid_json"], ["not_object"], ["task_id"], ["input"]]


def test_read_tasks_strict_and_lenient(spark, tmp_path):
    good = '{"task_id": "a-1", "domain": "bug_repair", "input": "x", "language": "python", "source_benchmark": "s"}'
    path = tmp_path / "tasks.jsonl"
    path.write_text(good + "\n\n{bad\n")
    with pytest.raises(ValueError):
        K.read_tasks(spark, str(path))
    kept, bad = K.read_tasks(spark, str(path), strict=False)
    assert kept.count() == 1 and bad.count() == 1


def test_thresholds(spark):
    rows = [(10, 0.95 if i < 7 else 0.5, None) for i in range(10)] + [(20, 0.92 if i < 9 else 0.1, None) for i in range(10)]
    sim = spark.createDataFrame(rows, "n_tasks int, kendall_tau double, g_coefficient_task double")
    got = {(r.metric, r.target): r.recommended_min_tasks_80pct_subsets for r in H.reliability_thresholds(sim).collect()}
    assert got == {("kendall_tau", 0.9): 20, ("kendall_tau", 0.95): None, ("g_coefficient_task", 0.8): None, ("g_coefficient_task", 0.9): None}


def test_threshold_layouts(spark):
    first = spark.createDataFrame([("kendall_tau", 0.9, 40)], "metric string, target double, recommended_min_tasks_80pct_subsets int")
    second = spark.createDataFrame([(0.9, 40)], "kendall_tau_target double, min_tasks_80pct_subsets int")
    third = spark.createDataFrame([("kendall_tau_recommendation", 0.9, 40, 0.8)], "metric string, target double, n_tasks int, fraction_meeting_target double")
    for table in (first, second, third):
        row = H.tau_minimums(table).first()
        assert (row.recommendation, row.value) == ("minimum_tasks_for_kendall_tau_0_9", "40")


def test_guidance_without_data(spark):
    assert H.design_guidance(frame(spark, [])).count() == 6


def test_full_subset_keeps_the_ranking(spark):
    df = crossed(spark, {"a": 0.9, "b": 0.5, "c": 0.1}, lambda m, t, p, r: 0.3 * ((t * 7 + ord(m)) % 3))
    rows = H.task_subsets(df, [4, 9], 5, 1).collect()
    assert {r.n_tasks for r in rows} == {4} and len(rows) == 10
    assert {r.kendall_tau for r in rows} == {1.0} and {r.pairwise_reversal_rate for r in rows} == {0.0}


def test_bootstrap_of_constants_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, None)], "g string, i int, v double")
    for ids in (["i"], None):
        got = {r.g: r for r in H.bootstrap_ci(df, "v", ids, ["g"], n_bootstrap=20).collect()}
        assert (got["a"].statistic, got["a"].ci_lower, got["a"].ci_upper) == (2.0, 2.0, 2.0)
        assert got["b"].statistic is None and got["b"].ci_lower is None and got["b"].n == 0


def test_counts_and_rows_agree_in_law(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    rows = H.bootstrap_ci(df, "v", ["id"], n_bootstrap=800).first()
    counts = H.bootstrap_ci(df, "v", n_bootstrap=800).first()
    assert rows.ci_lower == pytest.approx(counts.ci_lower, abs=0.012)
    assert rows.ci_upper == pytest.approx(counts.ci_upper, abs=0.012)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(1.0,)] * 3, "v double")
    rows = D.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 0, 3, 0]


def test_nested_prefixes(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    rows = H.nested_prefixes(df, ["k"], (10, 100, 900), 5)
    sets = {s: {r.k for r in rows.filter(F.col("size") == s).collect()} for s in (10, 100, 900)}
    assert [len(sets[s]) for s in (10, 100, 900)] == [10, 100, 500]
    assert sets[10] < sets[100] < sets[900]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_whole_log_schema_round_trips(spark, tmp_path, fmt):
    schema = RS.RESULT_SCHEMA
    values = {"cell_id": "a|b", "scores": {"pass_at_1": 1.0, "x,y": 0.5}, "metadata": {"k": 'quote " and\nline'}, "score": 0.25, "seed": 2**40, "prediction": "a,\n\"b\""}
    rows = [tuple(values.get(f.name) for f in schema.fields), tuple("c" if f.name == "cell_id" else None for f in schema.fields)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    path = RS.write_results(df, str(tmp_path / fmt), fmt)
    back = RS.read_results(spark, path, fmt=fmt, position=True)
    assert [f.name for f in back.schema.fields] == [f.name for f in schema.fields] + ["seq"]
    assert sorted(tuple(r)[:-1] for r in back.collect()) == sorted(rows)
    assert back.orderBy("seq").first()["cell_id"] == "a|b"


def test_last_row_of_a_file_wins_among_equal_times(spark, tmp_path):
    rows = [("c", "failed", 1), ("c", "completed", 1), ("c", "failed", 1), ("d", "completed", 1)]
    df = spark.createDataFrame(rows, "cell_id string, status string, executed_at long").coalesce(1)
    path = RS.write_results(df, str(tmp_path / "log"), "parquet")
    latest = C.latest_by_cell(RS.read_results(spark, path, fmt="parquet", position=True))
    assert {r["cell_id"]: r["status"] for r in latest.collect()} == {"c": "failed", "d": "completed"}


def test_a_metric_that_no_row_has_is_an_error(spark):
    df = spark.createDataFrame([("m", "t", {"x": 1.0})], "model string, task_id string, scores map<string,double>")
    with pytest.raises(ValueError, match="pass_at_1"):
        A.prepare_results(df, "pass_at_1")


def test_comparison_rounding_leaves_large_values_alone(spark):
    from gaugeframe.plans.registry import rounded

    values = [1e14, 3e13, float("inf"), float("-inf"), 0.12345649, -2.5]
    got = [r[0] for r in rounded(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)).collect()]
    assert got == [1e14, 3e13, float("inf"), float("-inf"), 0.123456, -2.5]
    assert rounded(spark.createDataFrame([(float("nan"),)], "x double")).filter("isnan(x)").count() == 1


def test_skewed_values_fill_their_bins_evenly(spark):
    import math

    from gaugeframe.functions.order_stats import BINS, with_counts_below

    values = [math.exp(i / 100) for i in range(4000)]
    df = spark.createDataFrame([("g", v, 2) for v in values], "g string, value double, c long")
    rows = {r["value"]: r["below"] for r in with_counts_below(df, ["g"]).collect()}
    assert [rows[v] for v in values] == [2 * i for i in range(4000)]
    cuts = df.groupBy("g").agg(F.percentile_approx("value", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("cuts"))
    most = df.join(cuts, "g").groupBy(F.expr("size(filter(cuts, c -> c <= value))")).count().agg(F.max("count")).first()[0]
    assert most < 4000 / BINS * 4
