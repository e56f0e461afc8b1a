"""Scoring predictions against references and summing the scores up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import text as T
from gaugeframe.operators.log import completed_latest

# Metrics of each task domain and the metrics that need running code or a judge.
CODE_METRICS = ("exact_match", "normalized_code_match", "syntax_check", "contains_expected")
EXECUTABLE_METRICS = ("syntax_check", "normalized_code_match", "token_count")
SUMMARY_METRICS = ("length", "lexical_overlap")
DOMAIN_METRICS = {
    "code_generation": CODE_METRICS,
    "bug_repair": CODE_METRICS,
    "executable_code_generation": EXECUTABLE_METRICS,
    "code_summarization": SUMMARY_METRICS,
}
# what scoring reads of the log; anything else would only be shuffled along
LOG_COLUMNS = ("cell_id", "model_id", "task_id", "prediction", "status", "executed_at", "seq")


def with_text_features(df: DataFrame, prediction: Column, reference: Column, metrics: tuple[str, ...]) -> DataFrame:
    """Add what the metrics share (normalised text, code, token sets), so each is made once per row."""
    features = {"_p": prediction, "_r": reference}
    wanted = set(metrics)
    if wanted & {"exact_match", "accuracy", "contains_expected", "length", "lexical_overlap"}:
        features |= {"_np": T.normalize_text(prediction), "_nr": T.normalize_text(reference)}
    if wanted & {"syntax_check", "normalized_code_match", "token_count"}:
        features |= {"_code": T.extract_code(prediction)}
    if "normalized_code_match" in wanted:
        features |= {"_ref_code": T.extract_code(reference)}
    return df.withColumns(features)


def metric_struct(name: str, tests: Column | None = None) -> Column:
    """struct(metric_name, metric_value, metric_success) of one metric over the shared features."""
    c = F.col
    if name in ("exact_match", "accuracy"):
        value = T.score(c("_np") == c("_nr"))
        success = value == 1.0
    elif name == "contains_expected":
        value = T.score((c("_nr") != "") & F.contains("_np", "_nr"))
        success = value == 1.0
    elif name == "normalized_code_match":
        value = T.code_equal(c("_code"), c("_ref_code"))
        success = value == 1.0
    elif name == "syntax_check":
        value = T.parses(c("_code"))
        success = value == 1.0
    elif name == "test_pass_rate" and tests is not None:
        value = T.test_pass_rate(c("_p"), c("_r"), tests)
        success = value >= 1.0
    elif name == "length":
        value = F.size(T.split_normal(c("_np"))).cast("double")
        success = value > 0
    elif name == "lexical_overlap":
        value = T.token_overlap(T.split_normal(c("_np")), T.split_normal(c("_nr")))[2]
        success = value >= 0.5
    elif name == "token_count":
        value = F.size(T.tokenize(F.when(c("_code") != "", c("_code")).otherwise(c("_p")))).cast("double")
        success = F.lit(True)
    else:
        raise ValueError(f"unsupported metric: {name}")
    return F.struct(F.lit(name).alias("metric_name"), value.alias("metric_value"), success.alias("metric_success"))


def evaluate_results(log: DataFrame, tasks: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per completed-latest cell and metric; unknown tasks are dropped.

    Each task's first record (by ``seq``) gives the reference. Without a list every domain gets its
    own metrics; a metric outside its domain's table is an error.
    """
    rows = completed_latest(log.select(*[c for c in LOG_COLUMNS if c in log.columns]))
    first = tasks.groupBy("task_id").agg(
        F.min_by(F.struct("domain", "expected_output", *(["tests"] if "tests" in tasks.columns else [])), "seq").alias("_ref")
    )
    joined = rows.join(first, "task_id")
    tests = F.col("_ref.tests") if "tests" in tasks.columns else None
    domain = F.col("_ref.domain")
    names = tuple(metrics) if metrics is not None else tuple(sorted({n for used in DOMAIN_METRICS.values() for n in used}))
    featured = with_text_features(joined, F.col("prediction"), F.col("_ref.expected_output"), names)
    if metrics is not None:
        scored = F.array(*[metric_struct(n, tests) for n in names])
    else:
        # each metric once, switched off where the domain does not use it
        per_metric = [
            F.when(domain.isin(*[d for d, used in DOMAIN_METRICS.items() if n in used]), metric_struct(n, tests)) for n in names
        ]
        scored = F.array_compact(F.array(*per_metric))
    return featured.select("cell_id", "model_id", "task_id", domain.alias("domain"), F.explode(scored).alias("m")).select(
        "cell_id", "model_id", "task_id", "domain", "m.*"
    )


def corpus_metric(name: str, df: DataFrame) -> DataFrame:
    """(name, value, success, n): mean of a row metric over a corpus; an empty corpus scores 0."""
    if name not in ("accuracy", "exact_match", "contains_expected", "length", "lexical_overlap"):
        raise ValueError(f"unknown corpus metric: {name}")
    featured = with_text_features(df, F.col("prediction"), F.col("expected_output"), (name,))
    one = featured.select(metric_struct(name)["metric_value"].alias("v")).agg(
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("value"), F.coalesce(F.bool_and(F.col("v") > 0), F.lit(False)).alias("all_positive"),
        F.count(F.lit(1)).alias("n"),
    )
    success = {"length": F.col("all_positive"), "lexical_overlap": F.col("value") >= 0.5}.get(name, F.col("value") == 1.0)
    return one.select(F.lit(name).alias("metric"), "value", (success & (F.col("n") > 0)).alias("success"), "n")


def average_scores(examples: DataFrame, position: str = "seq") -> DataFrame:
    """Per cell: mean of each metric over its examples, first prediction, summed latency."""
    exploded = examples.select("cell_id", F.explode("scores").alias("name", "v"))
    means = exploded.groupBy("cell_id", "name").agg(F.avg("v").alias("v"))
    maps = means.groupBy("cell_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("scores"))
    firsts = examples.groupBy("cell_id").agg(
        F.min_by("prediction", position).alias("prediction"), F.sum("latency_ms").alias("latency_ms"), F.count(F.lit(1)).alias("num_examples")
    )
    return firsts.join(maps, "cell_id", "left")


def metric_means(log: DataFrame) -> DataFrame:
    """Mean of every metric over completed rows; (metric, score) columns serve where no map holds values."""
    done = log.filter(F.col("status") == "completed") if "status" in log.columns else log
    if "scores" in log.columns:
        means = done.select(F.explode("scores").alias("metric", "v")).filter("v IS NOT NULL").groupBy("metric").agg(F.avg("v").alias("mean"))
        if not {"metric", "score"} <= set(log.columns) or means.limit(1).count():
            return means
    return done.groupBy("metric").agg(F.avg("score").alias("mean")).filter("mean IS NOT NULL")


def hidden_match_flag(means: DataFrame) -> DataFrame:
    """True when exact_match is 0 on average while normalized_code_match is not."""

    def mean_of(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("mean")))

    return means.agg(
        F.coalesce((mean_of("exact_match") == 0) & (mean_of("normalized_code_match") > 0), F.lit(False)).alias("only_normalized_matches")
    )


def extraction_diagnostics(df: DataFrame, score: str = "score") -> DataFrame:
    """By model: rows, mean score, empty-prediction rate and fence rate."""
    blank = T.normalize_text(F.coalesce("prediction", F.lit(""))) == ""
    return df.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(blank.cast("double")).alias("empty_rate"),
        F.avg(F.coalesce(F.contains("prediction", F.lit("```")), F.lit(False)).cast("double")).alias("fence_rate"),
    )


def compliant_panel(df: DataFrame, diagnostics: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows of the models whose diagnostic rate reaches ``minimum``."""
    kept = diagnostics.filter(F.col(column) >= minimum).select("model_id")
    return df.join(kept, "model_id", "left_semi")


def parse_rate(df: DataFrame) -> DataFrame:
    """Share of predictions per model whose extracted code parses as Python."""
    return df.select("model_id", T.syntax_check(F.col("prediction")).alias("ok")).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ok").alias("parse_rate")
    )
