"""Input views over the given tables: each one as a DataFrame and as the same projection in SQL.

The tables hold no experiment results, so the views read line items as measured cells, events as
the append-only result log, conversations as predictions with references, and documents as tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = "```"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def utc(df: DataFrame, name: str) -> Column:
    """A time column as an instant; a naive time means UTC, whatever the session's zone is."""
    column = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        column = F.convert_timezone(F.lit("UTC"), F.current_timezone(), column)
    return column.cast("timestamp")


def _cells(spark: SparkSession, sf: str, lift: int, graded: bool = False) -> DataFrame:
    li = table(spark, sf, "lineitem")
    model = F.col("l_suppkey") % 6
    passed = F.col("l_quantity") + lift * model > F.col("l_partkey") % 40
    score = F.col("l_quantity") / 50.0 if graded else F.when(passed, 1.0).otherwise(0.0)
    return li.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("cell_id"),
        F.concat(F.lit("m"), model).alias("model"),
        F.concat(F.lit("t"), F.col("l_partkey") % 164).alias("task_id"),
        F.col("l_returnflag").alias("prompt_id"),
        F.col("l_linenumber").alias("run_id"),
        F.when(F.col("l_linestatus") == "O", 0.2).otherwise(0.0).alias("temperature"),
        F.lit("graded" if graded else "pass_at_1").alias("metric_name"),
        score.alias("metric_value"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Measured cells: model x task x prompt x temperature x run."""
    return _cells(spark, sf, 3)


def cells_close(spark: SparkSession, sf: str) -> DataFrame:
    """The same cells with nearly equal models, for fragile rankings."""
    return _cells(spark, sf, 0)


def cells_graded(spark: SparkSession, sf: str) -> DataFrame:
    """The same cells with a continuous score instead of pass/fail."""
    return _cells(spark, sf, 3, graded=True)


def cells_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of every model x prompt x temperature x run: each combination exactly once."""
    keys = ["model", "prompt_id", "temperature", "run_id"]
    return cells_graded(spark, sf).groupBy(*keys).agg(F.round(F.avg("metric_value"), 9).alias("metric_value"))


def cells_by_task(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of every model x task: each pair exactly once."""
    return cells_graded(spark, sf).groupBy("model", "task_id").agg(F.avg("metric_value").alias("metric_value"))


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only result log: several rows per cell, a later row supersedes."""
    value = F.col("value")
    failed = F.col("event_type") == "error"
    events = table(spark, sf, "events")
    return events.select(
        F.concat_ws("|", "user_id", props_k() % 10).alias("cell_id"),
        F.concat(F.lit("m"), F.col("user_id") % 6).alias("model_id"),
        F.concat(F.lit("t"), props_k() % 10).alias("task_id"),
        F.lit("default").alias("prompt_variant_id"),
        F.lit(0.0).alias("temperature"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, "error").alias("error"),
        utc(events, "ts").alias("executed_at"),
        F.col("event_id").alias("seq"),
        F.create_map(
            F.lit("pass_at_1"), F.when(value > 30, 1.0).otherwise(0.0), F.lit("token_count"), value
        ).alias("scores"),
        value.alias("latency_ms"),
        F.col("event_type").alias("prediction"),
    )


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """One row per checkpointed cell: the state its latest non-view event left behind."""
    seen = log(spark, sf).filter(F.col("prediction") != "view")
    return seen.groupBy("cell_id").agg(
        F.max_by("status", F.struct("executed_at", "seq")).alias("status")
    )


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """Expected design of the log: every user id shifted by 10, times 10 tasks."""
    users = table(spark, sf, "events").select((F.col("user_id") + 10).alias("u")).distinct()
    return users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        F.concat_ws("|", "u", "k").alias("cell_id"),
        F.concat(F.lit("m"), F.col("u") % 6).alias("model_id"),
        F.concat(F.lit("t"), F.col("k")).alias("task_id"),
        F.lit("default").alias("prompt_variant_id"),
        F.lit(0.0).alias("temperature"),
        F.lit(0).alias("run_index"),
        F.lit(42).alias("seed"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction and reference: each turn is the reference of the turn after it."""
    turns = table(spark, sf, "conversations")
    ref = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected_output"))
    kind = F.col("conv_id") % 4
    wrapped = (
        F.when(kind == 0, F.concat(F.lit(f"{FENCE}python\n"), "text", F.lit(f"\n{FENCE}")))
        .when(kind == 1, F.concat(F.lit(f"{FENCE}\n"), "text", F.lit(f"\n{FENCE}")))
        .when(kind == 2, F.concat("text", F.lit("\ndef f(): return 1")))
        .otherwise(F.col("text"))
    )
    return turns.join(ref, ["conv_id", "turn"]).select(
        F.concat_ws("|", "conv_id", "turn").alias("cell_id"),
        F.col("conv_id").cast("string").alias("task_id"),
        F.col("role").alias("model_id"),
        F.col("turn").alias("seq"),
        wrapped.alias("prediction"),
        "expected_output",
    )


def doc_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Task records from documents; every tenth id repeats its predecessor's."""
    d = F.col("doc_id")
    domain = (
        F.when(d % 3 == 0, "code_generation").when(d % 3 == 1, "bug_repair").otherwise("code_summarization")
    )
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d-"), d - F.when(d % 10 == 9, 1).otherwise(0)).alias("task_id"),
        domain.alias("domain"),
        F.col("text").alias("input"),
        F.col("text").alias("expected_output"),
        F.lit("python").alias("language"),
        F.col("source").alias("source_benchmark"),
        d.alias("seq"),
    )


VIEW_SQL: dict[str, str] = {
    "cells": """
        SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cell_id,
               'm' || (l_suppkey % 6) AS model, 't' || (l_partkey % 164) AS task_id,
               l_returnflag AS prompt_id, l_linenumber AS run_id,
               CASE WHEN l_linestatus = 'O' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
               'pass_at_1' AS metric_name,
               CASE WHEN l_quantity + 3 * (l_suppkey % 6) > l_partkey % 40
                    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric_value
        FROM lineitem""",
    "cells_close": """
        SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cell_id,
               'm' || (l_suppkey % 6) AS model, 't' || (l_partkey % 164) AS task_id,
               l_returnflag AS prompt_id, l_linenumber AS run_id,
               CASE WHEN l_linestatus = 'O' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
               'pass_at_1' AS metric_name,
               CASE WHEN l_quantity > l_partkey % 40
                    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric_value
        FROM lineitem""",
    "cells_graded": """
        SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cell_id,
               'm' || (l_suppkey % 6) AS model, 't' || (l_partkey % 164) AS task_id,
               l_returnflag AS prompt_id, l_linenumber AS run_id,
               CASE WHEN l_linestatus = 'O' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
               'graded' AS metric_name, l_quantity / 50.0::DOUBLE AS metric_value
        FROM lineitem""",
    "cells_balanced": """
        SELECT model, prompt_id, temperature, run_id, round(avg(metric_value), 9) AS metric_value
        FROM cells_graded GROUP BY ALL""",
    "cells_by_task": """
        SELECT model, task_id, avg(metric_value) AS metric_value FROM cells_graded GROUP BY ALL""",
    "log": """
        SELECT user_id || '|' || (k % 10) AS cell_id, 'm' || (user_id % 6) AS model_id,
               't' || (k % 10) AS task_id, 'default' AS prompt_variant_id, 0.0::DOUBLE AS temperature,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN event_type = 'error' THEN 'error' END AS error,
               ts AS executed_at, event_id AS seq,
               CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pass_at_1,
               value AS token_count, value AS latency_ms, event_type AS prediction
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "checkpoints": """
        SELECT cell_id, arg_max(status, row(executed_at, seq)) AS status
        FROM log WHERE prediction <> 'view' GROUP BY cell_id""",
    "expected": """
        SELECT u || '|' || k AS cell_id, 'm' || (u % 6) AS model_id, 't' || k AS task_id,
               'default' AS prompt_variant_id, 0.0::DOUBLE AS temperature, 0 AS run_index, 42 AS seed
        FROM (SELECT DISTINCT user_id + 10 AS u FROM events), range(10) r(k)""",
    "latest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id
                       ORDER BY executed_at DESC, seq DESC) AS rn FROM log) WHERE rn = 1""",
    "texts": """
        SELECT t.conv_id || '|' || t.turn AS cell_id, CAST(t.conv_id AS VARCHAR) AS task_id,
               t.role AS model_id, t.turn AS seq,
               CASE t.conv_id % 4
                    WHEN 0 THEN '```python' || chr(10) || t.text || chr(10) || '```'
                    WHEN 1 THEN '```' || chr(10) || t.text || chr(10) || '```'
                    WHEN 2 THEN t.text || chr(10) || 'def f(): return 1'
                    ELSE t.text END AS prediction,
               r.text AS expected_output
        FROM conversations t JOIN conversations r ON r.conv_id = t.conv_id AND r.turn + 1 = t.turn""",
    "doc_tasks": """
        SELECT 'd-' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) AS task_id,
               CASE doc_id % 3 WHEN 0 THEN 'code_generation' WHEN 1 THEN 'bug_repair'
                    ELSE 'code_summarization' END AS domain,
               text AS input, text AS expected_output, 'python' AS language,
               source AS source_benchmark, doc_id AS seq
        FROM documents""",
}
