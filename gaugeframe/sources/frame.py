"""From results or evaluations to the statistical frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.log import ORDER, completed_latest
from gaugeframe.sources.results import write_results

# Canonical column and the names it may carry in results and evaluations.
ALIASES = {
    "model": ("model", "model_id"),
    "task_id": ("task_id", "task"),
    "prompt_id": ("prompt_id", "prompt_variant_id"),
    "run_id": ("run_id", "run_index"),
    "temperature": ("temperature",),
    "metric_name": ("metric_name", "metric"),
    "metric_value": ("metric_value", "score"),
}
DEFAULTS = {"metric_name": "score", "prompt_id": "default", "run_id": 0, "temperature": 0.0}
REQUIRED = ("model", "task_id", "metric_value")


def not_nan(value: Column) -> Column:
    """Double with NaN as null."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def prepare_results(df: DataFrame, metric: str | None = None) -> DataFrame:
    """Canonical columns; the score comes from ``scores[metric]`` where a scores map holds it."""
    renames = {}
    for name, options in ALIASES.items():
        if name not in df.columns:
            source = next((o for o in options if o in df.columns), None)
            if source is not None:
                renames[source] = name
    out = df.withColumnsRenamed(renames)
    if metric is not None and "scores" in out.columns:
        # where a stored score exists too, a map without the metric anywhere leaves it in place
        scored = F.element_at("scores", F.lit(metric))
        found = not out.filter(scored.isNotNull()).isEmpty()
        if not found and "metric_value" not in out.columns:
            raise ValueError(f"no row has a score named {metric}, and there is no metric_value")
        if found:
            out = out.filter(scored.isNotNull()).withColumns({"metric_value": scored, "metric_name": F.lit(metric)})
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"results lack required columns: {', '.join(missing)}")
    for name, value in DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    if metric is not None:
        out = out.filter(F.col("metric_name") == metric)
    return out.withColumn("metric_value", not_nan(F.col("metric_value")))


def use_replicate_index(df: DataFrame) -> DataFrame:
    """Take ``run_index`` for ``run_id`` when run_id names one run only (nulls count as a value)."""
    if "run_index" not in df.columns:
        return df
    if "run_id" in df.columns:
        two = df.select("run_id").distinct().limit(2).count()
        if two > 1:
            return df
    return df.withColumn("run_id", F.col("run_index"))


def analysis_frame(
    stats: DataFrame | None, results: DataFrame | None, strict: bool = True, metric: str | None = None,
    order: tuple[str, ...] = ("executed_at", "seq"),
) -> DataFrame:
    """The frozen statistical table when there is one, else completed-latest results (not in strict mode)."""
    if stats is not None:
        raw = completed_latest(stats, order) if "status" in stats.columns else stats
    elif strict:
        raise FileNotFoundError("strict analysis needs the statistical table; the append-only log is not used")
    elif results is not None:
        raw = completed_latest(results, order)
    else:
        raise FileNotFoundError("neither a statistical table nor results")
    return use_replicate_index(prepare_results(raw, metric))


def build_statistical_dataset(log: DataFrame, metric: str, path: str | None = None) -> DataFrame:
    """Completed-latest rows of the log as a statistical frame; written by metric when a path is given.

    Only the columns of the frame pass the shuffle; predictions and metadata stay behind.
    """
    used = {"cell_id", "status", "scores", "run_index", *ORDER, *[o for options in ALIASES.values() for o in options]}
    narrow = log.select(*[c for c in log.columns if c in used])
    frame = use_replicate_index(prepare_results(completed_latest(narrow), metric)).drop("scores")
    if path is None:
        return frame
    write_results(frame, path, "parquet", partition_by="metric_name")
    return log.sparkSession.read.parquet(path)


def primary_score(metric: str, scores: str = "scores") -> Column:
    """scores[metric]; 'accuracy' may fall back to exact_match; else the value of the smallest key; else 0."""
    column = F.col(scores)
    options = [F.element_at(column, F.lit(metric))]
    if metric == "accuracy":
        options.append(F.element_at(column, F.lit("exact_match")))
    first_key = F.array_min(F.map_keys(column))
    options.append(F.when(first_key.isNotNull(), F.element_at(column, first_key)))
    return F.coalesce(*options, F.lit(0.0))
