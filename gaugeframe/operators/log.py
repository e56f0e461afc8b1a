"""Reconciliation and quality checks of the append-only result log.

"Latest" is an aggregate (max_by), so partial results are combined before the shuffle and a cell
with very many log rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("executed_at", "seq")


def latest_by_cell(log: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Newest row of any status per cell; equal times are decided by the later log position."""
    ranked = [c for c in order if c in log.columns]
    rest = [c for c in log.columns if c != "cell_id"]
    newest = F.max_by(F.struct(*rest), F.struct(*ranked))
    return log.groupBy("cell_id").agg(newest.alias("_row")).select("cell_id", "_row.*")


def completed_latest(log: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Completed rows only, the last one per cell."""
    done = log.filter(F.col("status") == "completed") if "status" in log.columns else log
    if "cell_id" not in log.columns:
        return done
    if not any(c in log.columns for c in order):
        raise ValueError(f"the log needs one of {order} to say which row is the last")
    return latest_by_cell(done, order)


def terminal_counts(log: DataFrame) -> DataFrame:
    """Cells whose latest row is completed / failed / skipped."""
    return latest_by_cell(log.select("cell_id", "status", *_order(log))).groupBy("status").agg(F.count(F.lit(1)).alias("cells"))


def _order(log: DataFrame) -> list[str]:
    return [c for c in ORDER if c in log.columns]


def duplicate_cells(log: DataFrame) -> DataFrame:
    """Cell ids with more than one row."""
    return log.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def missing_cells(expected: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Expected cells without a completed checkpoint, fully specified: the retry worklist."""
    done = checkpoints.filter(F.col("status") == "completed").select("cell_id")
    return expected.join(done, "cell_id", "left_anti")


def observed_cells(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row per seen cell with five membership flags."""
    latest = latest_by_cell(log.select("cell_id", "status", *_order(log)))

    def flag(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)))

    seen = latest.select("cell_id", F.col("status").alias("r"), F.lit(None).cast("string").alias("c")).unionByName(
        checkpoints.select("cell_id", F.lit(None).cast("string").alias("r"), F.col("status").alias("c"))
    )
    return seen.groupBy("cell_id").agg(
        flag(F.col("c") == "completed").alias("checkpoint_completed"),
        flag(F.col("c") == "failed").alias("checkpoint_failed"),
        flag(F.col("r").isNotNull()).alias("result_all"),
        flag(F.col("r") == "completed").alias("result_completed"),
        flag(F.col("r") == "failed").alias("result_failed"),
    )


def unexpected_cells(expected: DataFrame, log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Cells seen in the log or among completed/failed checkpoints that the design does not have."""
    terminal = checkpoints.filter(F.col("status").isin("completed", "failed"))
    seen = log.select("cell_id").union(terminal.select("cell_id")).distinct()
    return seen.join(expected.select("cell_id"), "cell_id", "left_anti")


def coverage_counts(expected: DataFrame, log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The nine counts of the coverage report from one grouping by cell."""
    flags = observed_cells(log, checkpoints).withColumn("is_expected", F.lit(False))
    wanted = expected.select("cell_id").distinct().select(
        "cell_id", *[F.lit(False).alias(c) for c in FLAGS], F.lit(True).alias("is_expected")
    )
    merged = flags.unionByName(wanted).groupBy("cell_id").agg(
        *[F.max(c).alias(c) for c in (*FLAGS, "is_expected")]
    )
    duplicates = duplicate_cells(log).agg(F.count(F.lit(1)).alias("duplicate_cell_ids"))
    seen = F.col("result_all") | F.col("checkpoint_completed") | F.col("checkpoint_failed")
    counts = merged.agg(
        F.count_if("is_expected").alias("expected_cells"),
        F.count_if("checkpoint_completed").alias("checkpoint_completed_cells"),
        F.count_if("checkpoint_failed").alias("checkpoint_failed_cells"),
        F.count_if("result_all").alias("result_cells"),
        F.count_if("result_completed").alias("result_completed_cells"),
        F.count_if("result_failed").alias("result_failed_cells"),
        F.count_if(F.col("is_expected") & ~F.col("checkpoint_completed")).alias("missing_cell_ids"),
        F.count_if(~F.col("is_expected") & seen).alias("unexpected_cell_ids"),
    )
    return counts.join(F.broadcast(duplicates))


FLAGS = ("checkpoint_completed", "checkpoint_failed", "result_all", "result_completed", "result_failed")


def recovery_audit(worklist: DataFrame, log_before: DataFrame, log_after: DataFrame) -> DataFrame:
    """What became of each listed cell: already completed, recovered, failed again or not retried."""
    keys = ["cell_id", "status"]
    before = latest_by_cell(log_before.select(*keys, *_order(log_before))).select("cell_id", F.col("status").alias("before"))
    after = latest_by_cell(log_after.select(*keys, *_order(log_after))).select("cell_id", F.col("status").alias("after"))
    action = (
        F.when(F.col("before") == "completed", "skip_already_completed")
        .when(F.col("after") == "completed", "recovered")
        .when(F.col("after").isNotNull(), "retry_failed")
        .otherwise("not_retried")
    )
    listed = worklist.select("cell_id").distinct()
    return listed.join(before, "cell_id", "left").join(after, "cell_id", "left").select("cell_id", action.alias("action"))


def recovery_summary(audit: DataFrame) -> DataFrame:
    """Totals of the audit; failed and never retried cells remain missing."""
    return audit.agg(
        F.count_if(F.col("action") == "recovered").alias("recovered_cells"),
        F.count_if(F.col("action") == "skip_already_completed").alias("skipped_cells"),
        F.count_if(F.col("action") == "retry_failed").alias("still_failed_cells"),
        F.count_if(F.col("action").isin("retry_failed", "not_retried")).alias("remaining_missing_cells"),
    )


def experiment_status(expected: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """Progress of an experiment at time ``now`` (UTC): counts, percent, elapsed time, rate and ETA."""
    latest = latest_by_cell(log.select("cell_id", "status", *_order(log)))
    counts = latest.agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    start = log.agg(F.min("executed_at").alias("started_at"))
    sizes = expected.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("expected"))
    return status_columns(counts.join(F.broadcast(start)).join(F.broadcast(sizes)), now)


def status_columns(one: DataFrame, now: str) -> DataFrame:
    """Derived columns from completed, failed, expected and started_at."""
    pending = F.greatest(F.col("expected") - F.col("completed") - F.col("failed"), F.lit(0))
    elapsed = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros("started_at") / 1e6
    running = (F.col("elapsed_seconds") > 0) & (F.col("completed") > 0)
    return (
        one.withColumn("pending", pending)
        .withColumn("elapsed_seconds", elapsed)
        .select(
            "expected", "completed", "failed", "pending",
            F.when(F.col("expected") > 0, 100.0 * F.col("completed") / F.col("expected")).otherwise(0.0).alias("percent_complete"),
            "elapsed_seconds",
            F.when(running, F.col("completed") / (F.col("elapsed_seconds") / 3600.0)).alias("cells_per_hour"),
            F.when(running & (F.col("pending") > 0), F.col("pending") / (F.col("completed") / F.col("elapsed_seconds"))).alias("eta_seconds"),
        )
    )


def model_distribution(log: DataFrame) -> DataFrame:
    """Row count per model, largest first."""
    model = "model_id" if "model_id" in log.columns else "model"
    return log.groupBy(F.col(model).alias("model")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "model")


def metric_mean(df: DataFrame, metric: str = "pass_at_1") -> DataFrame:
    """Mean of a metric from its own column, from long rows, or from a bare value column, in that order."""
    if metric in df.columns:
        return df.agg(F.avg(metric).alias("mean"))
    if {"metric_name", "metric_value"} <= set(df.columns):
        return df.filter(F.col("metric_name") == metric).agg(F.avg("metric_value").alias("mean"))
    if "metric_value" in df.columns:
        return df.agg(F.avg("metric_value").alias("mean"))
    raise ValueError(f"no column holds {metric}")


def failures(log: DataFrame) -> DataFrame:
    """Failed rows with their cell keys and error."""
    keys = ["cell_id", "model_id", "task_id", "prompt_variant_id", "temperature", "run_index", "error", *ORDER]
    return log.filter(F.col("status") == "failed").select(*[c for c in keys if c in log.columns])


def integrity_audit(
    expected: DataFrame, log: DataFrame, checkpoints: DataFrame, stats: DataFrame, evaluations: DataFrame
) -> DataFrame:
    """(check, value, ok): every table is reduced to flags per cell in one grouping."""
    names = ("expected", "rows", "completed_rows", "failed_rows", "checkpoint", "stats", "evals")

    def counted(df: DataFrame, **flags: Column) -> DataFrame:
        return df.select("cell_id", *[flags.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    marks = (
        counted(expected.select("cell_id").distinct(), expected=one)
        .unionByName(
            counted(
                log, rows=one, completed_rows=(F.col("status") == "completed").cast("int"),
                failed_rows=(F.col("status") == "failed").cast("int"),
            )
        )
        .unionByName(counted(checkpoints.filter("status = 'completed'"), checkpoint=one))
        .unionByName(counted(stats.select("cell_id"), stats=one))
        .unionByName(counted(evaluations.select("cell_id"), evals=one))
    )
    per_cell = marks.groupBy("cell_id").agg(*[F.sum(n).alias(n) for n in names])
    latest = latest_by_cell(log.select("cell_id", "status", *_order(log))).agg(
        F.count_if(F.col("status") == "completed").alias("latest_completed"), F.count_if(F.col("status") == "failed").alias("latest_failed")
    )
    is_expected, has_rows = F.col("expected") > 0, F.col("rows") > 0
    totals = per_cell.agg(
        F.count_if(is_expected).alias("expected_cells"),
        F.sum("rows").alias("log_rows"),
        F.count_if(has_rows).alias("unique_cells"),
        F.count_if(F.col("rows") > 1).alias("duplicate_cells"),
        F.sum("completed_rows").alias("completed_rows"),
        F.sum("failed_rows").alias("failed_rows"),
        F.count_if(has_rows & ~is_expected).alias("orphan_log_cells"),
        F.count_if(is_expected & ~has_rows).alias("cells_without_log"),
        F.count_if((F.col("checkpoint") > 0) & (F.col("completed_rows") == 0)).alias("orphan_checkpoints"),
        F.count_if((F.col("completed_rows") > 0) & (F.col("stats") == 0)).alias("completed_without_stats"),
        F.count_if((F.col("stats") > 0) & (F.col("completed_rows") == 0)).alias("stats_without_completed"),
        F.count_if((F.col("completed_rows") > 0) & (F.col("evals") == 0)).alias("completed_without_evals"),
    ).join(F.broadcast(latest))
    must_be_zero = (
        "orphan_log_cells", "cells_without_log", "orphan_checkpoints", "completed_without_stats",
        "stats_without_completed", "completed_without_evals", "latest_failed",
    )
    checks = [
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("value"), ((F.col(c) == 0) if c in must_be_zero else F.lit(True)).alias("ok"))
        for c in totals.columns
    ]
    broken = sum((F.col(c) for c in must_be_zero), F.lit(0))
    verdict = F.struct(F.lit("verdict").alias("check"), broken.cast("bigint").alias("value"), (broken == 0).alias("ok"))
    return totals.select(F.explode(F.array(*checks, verdict)).alias("c")).select("c.*")


def table_fingerprint(df: DataFrame, recorded: str | None = None) -> DataFrame:
    """Content hash that ignores row order, with the row count, compared with a recorded value if given.

    A cell goes in with its length, so no two rows of cells read alike; two sums of 60 bits of each row's md5 make the
    fingerprint.
    """
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("N")) for t in texts]
    digest = F.md5(F.concat(*cells))
    half = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    out = df.select(digest.alias("_h")).agg(F.concat(half(1), F.lit("-"), half(16)).alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))
    return out if recorded is None else out.withColumn("matches", F.col("fingerprint") == recorded)


def sanity_checks(log: DataFrame, metric: str, temperatures: tuple[float, ...]) -> DataFrame:
    """(check, ok): predictions there, temperatures as asked for, metric present, outcome not constant."""
    score = F.element_at("scores", F.lit(metric))
    one = log.filter(F.col("status") == "completed").agg(
        F.bool_and(F.trim(F.coalesce("prediction", F.lit(""))) != "").alias("predictions_non_empty"),
        F.bool_and(F.col("temperature").isin(*temperatures)).alias("temperature_as_requested"),
        F.bool_and(score.isNotNull()).alias("metric_present"),
        (F.min(score) < F.max(score)).alias("outcome_varies"),
    )
    checks = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for c in one.columns]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def timing_breakdown(log: DataFrame, projected_rows: int, sandbox_metric: str = "execution_latency_ms", wall_ms: float | None = None) -> DataFrame:
    """Model, sandbox and remaining I/O time in ms, and the hours the full design would take."""
    sandbox = F.coalesce(F.element_at("scores", F.lit(sandbox_metric)), F.lit(0.0))
    one = log.agg(
        F.sum("latency_ms").alias("model_ms"), F.sum(sandbox).alias("sandbox_ms"), F.count(F.lit(1)).alias("n_rows"),
        ((F.unix_micros(F.max("executed_at")) - F.unix_micros(F.min("executed_at"))) / 1e3).alias("_span"),
    )
    wall = F.lit(wall_ms) if wall_ms is not None else F.col("_span")
    used = F.col("model_ms") + F.col("sandbox_ms")
    return one.select(
        "n_rows", "model_ms", "sandbox_ms", F.greatest(wall - used, F.lit(0.0)).alias("io_ms"),
        (F.greatest(wall, used) / F.col("n_rows") * projected_rows / 3.6e6).alias("projected_hours"),
    )


def inspect(results: DataFrame, evaluations: DataFrame, limit: int | None = None) -> DataFrame:
    """Completed rows with their expected output (first per cell) and metric map.

    Metrics come from evaluations where the cell has any, else from the scores map.
    """
    per_cell = evaluations.groupBy("cell_id").agg(
        F.min_by("expected_output", "seq").alias("expected_output"),
        F.map_from_entries(
            F.array_sort(F.collect_set(F.when(F.col("metric_value").isNotNull(), F.struct("metric_name", "metric_value"))))
        ).alias("_evaluated"),
    )
    done = results.filter(F.col("status") == "completed")
    if limit is not None:
        done = done.orderBy("cell_id", *_order(results)).limit(limit)
    scored = F.map_filter("scores", lambda _, v: v.isNotNull())
    return done.join(per_cell, "cell_id", "left").select(
        "cell_id", "task_id", F.col("prompt_variant_id").alias("prompt_id"), F.col("model_id").alias("model"), "prediction",
        F.coalesce("expected_output", F.lit("")).alias("expected_output"),
        F.when(F.size("_evaluated") > 0, F.col("_evaluated")).otherwise(scored).alias("metrics"), *_order(results),
    )


def usage_cost(log: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add ``estimated_cost`` per row; null without any token count or without a configured price."""
    priced = log.join(pricing, "model_id", "left")
    known = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    configured = F.col("input_per_million").isNotNull() | F.col("output_per_million").isNotNull()

    def part(tokens: str, rate: str) -> Column:
        return F.coalesce(tokens, F.lit(0)) * F.coalesce(rate, F.lit(0.0))

    cost = (part("prompt_tokens", "input_per_million") + part("completion_tokens", "output_per_million")) / 1e6
    return priced.withColumn("estimated_cost", F.when(known & configured, cost))


def usage_by_model(costed: DataFrame) -> DataFrame:
    """Token and cost sums per model."""
    return costed.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("estimated_cost").alias("estimated_cost"),
    )
