"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` below `spark.checkpoint.dir` and go on from the files: lineage is cut and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession) -> int:
    """Parts that packed rows are dealt to: as many as the session shuffles into, so a part's size is set with the data."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
