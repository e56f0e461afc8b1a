"""Descriptive tables over factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.order_stats import exact_quantiles


def _factor_name(factors: list[str]) -> Column:
    """Name of the single factor of a grouping set. Kept simple: join filters end up on it."""
    return F.coalesce(*[F.when(F.grouping(f) == 0, f) for f in factors])


def _by_factor(
    df: DataFrame, factors: list[str], value: str, extra: list[str], aggregates: list[Column], by: list[str] | None = None
) -> DataFrame:
    extra = [*(by or []), *extra]
    rows = df.select(
        *(by or []), *[F.col(f).cast("string").alias(f) for f in factors], F.col(value).cast("double").alias("value")
    )
    rows = rows.filter(F.col("value").isNotNull())
    sets = [[f, *extra] for f in factors]
    out = rows.groupingSets(sets, *factors, *extra).agg(
        _factor_name(factors).alias("factor"), F.coalesce(*factors).alias("level"), *aggregates
    )
    return out.drop(*factors).filter("level IS NOT NULL")


def level_values(
    df: DataFrame, factors: list[str], value: str = "metric_value", by: list[str] | None = None
) -> DataFrame:
    """(factor, level, value, c): each distinct value counted once per level, all factors in one pass."""
    return _by_factor(df, factors, value, ["value"], [F.count(F.lit(1)).alias("c")], by)


def level_moments(
    df: DataFrame, factors: list[str], value: str = "metric_value", by: list[str] | None = None
) -> DataFrame:
    """(factor, level, n, mean, var) for all factors in one pass."""
    moments = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")]
    return _by_factor(df, factors, value, [], moments, by)


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe_all(
    df: DataFrame, factors: list[str], value: str = "metric_value", approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles, max and sem per level of each factor present.

    Quartiles are exact (linear interpolation) from value counts. ``approximate`` swaps them for
    ``percentile_approx``, which needs no second aggregate.
    """
    factors = [f for f in factors if f in df.columns]
    if approximate:
        stats = [
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
            *[F.percentile_approx("value", p, 10000).alias(q) for q, p in QUARTILES.items()],
        ]
        table = _by_factor(df, factors, value, [], stats)
    else:
        # everything comes from the value counts: one pass over the rows
        table = exact_quantiles(level_values(df, factors, value), ["factor", "level"], QUARTILES, moments=True)
    return table.select(
        "factor", "level", "count", "mean", "std", "min", "q25", "median", "q75", "max",
        (F.col("std") / F.sqrt("count")).alias("sem"),
    )


def describe_by(df: DataFrame, factor: str, value: str = "metric_value", approximate: bool = False) -> DataFrame:
    """``describe_all`` for one factor."""
    return describe_all(df, [factor], value, approximate).drop("factor").withColumnRenamed("level", factor)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Level counts, observations and metric of a statistical frame."""
    return df.agg(
        *[
            F.countDistinct(c).alias(n)
            for c, n in (
                ("model", "n_models"),
                ("task_id", "n_tasks"),
                ("prompt_id", "n_prompts"),
                ("run_id", "n_runs"),
                ("temperature", "n_temperatures"),
            )
        ],
        F.count(F.lit(1)).alias("n_observations"),
        F.min("metric_name").alias("metric"),
    )


def performance_table(description: DataFrame, intervals: DataFrame, factor: str) -> DataFrame:
    """Description joined with bootstrap intervals, best level first."""
    ci = intervals.select(
        factor, F.col("ci_lower").alias("ci_95_lower"), F.col("ci_upper").alias("ci_95_upper")
    )
    return (
        description.join(ci, factor)
        .select(factor, "count", "mean", "std", "ci_95_lower", "ci_95_upper", "sem", "median")
        .orderBy(F.desc("mean"), factor)
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts between min and max, last bin closed; empty bins are kept."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    span = values.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    # a constant column gets the unit range around it
    flat = F.col("hi") == F.col("lo")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        values.join(F.broadcast(span))
        .groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    frame = span.filter("lo IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def compare_point_estimates(subset: DataFrame, full: DataFrame, value: str = "metric_value") -> DataFrame:
    """Per model of ``full``: both means, their difference and min-method ranks; plus an overall row."""
    means = (
        full.select("model", F.col(value).alias("_f"), F.lit(None).cast("double").alias("_s"))
        .unionByName(subset.select("model", F.lit(None).cast("double").alias("_f"), F.col(value).alias("_s")))
        .groupingSets([["model"], []], "model")
        .agg(
            F.grouping("model").alias("_all"),
            F.avg("_s").alias("subset_pass_at_1"),
            F.avg("_f").alias("full_pass_at_1"),
            F.count("_f").alias("_n"),
        )
        .filter("_n > 0 AND (_all = 1 OR model IS NOT NULL)")
    )
    diff = (F.col("full_pass_at_1") - F.col("subset_pass_at_1")).alias("absolute_difference")
    # ranks are over models only; one row per model
    per_model = means.filter("_all = 0")

    def ranked(column: str) -> Column:
        rank = F.rank().over(Window.partitionBy("_all").orderBy(F.desc_nulls_last(F.round(column, 12))))
        return F.when(F.col(column).isNotNull(), rank.cast("double"))

    ranks = per_model.select(
        "model", "subset_pass_at_1", "full_pass_at_1", diff,
        ranked("subset_pass_at_1").alias("subset_rank"), ranked("full_pass_at_1").alias("full_rank"),
    ).withColumn("rank_difference", F.col("full_rank") - F.col("subset_rank"))
    none = F.lit(None).cast("double")
    overall = means.filter("_all = 1").select(
        F.lit("__overall__").alias("model"), "subset_pass_at_1", "full_pass_at_1", diff,
        none.alias("subset_rank"), none.alias("full_rank"), none.alias("rank_difference"),
    )
    return ranks.unionByName(overall)


def run_agreement(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """Share of (model, task, prompt, temperature) cells whose runs all agree, per temperature and overall."""
    keys = ["model", "task_id", "prompt_id", "temperature"]
    per_cell = df.groupBy(*keys).agg((F.min(value) == F.max(value)).cast("double").alias("same"))
    out = per_cell.groupingSets([["temperature"], []], "temperature").agg(
        F.grouping("temperature").alias("_all"), F.avg("same").alias("agreement"), F.count(F.lit(1)).alias("n_cells")
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise("temperature")
    return out.select(scope.alias("scope"), "temperature", "agreement", "n_cells")
