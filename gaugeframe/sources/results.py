"""Result tables in Parquet, JSON lines and CSV. CSV keeps maps, lists and structs as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File suffixes and the writer format they stand for.
FORMATS = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}
# ISO-8601 with microseconds; the default writer keeps milliseconds only
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_index", T.IntegerType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("provider_name", T.StringType()),
        T.StructField("provider_type", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("prompt_variant_id", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("seed", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("prediction", T.StringType()),
        T.StructField("num_examples", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("executed_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def format_of(path: str) -> str:
    """Reader format from the path's suffix (a folder may carry one too)."""
    name = path.rstrip("/").lower()
    for suffix, fmt in FORMATS.items():
        if name.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported results format: {path}")


def _nested(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType)]


def _read_csv(reader, path: str, schema: T.StructType) -> DataFrame:
    nested = {f.name: f.dataType for f in _nested(schema)}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema.fields])
    out = reader.schema(flat).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return out.withColumns({name: F.from_json(name, kind) for name, kind in nested.items()}) if nested else out


def with_position(df: DataFrame) -> DataFrame:
    """Add ``seq``, the place of a row in its file and of the file by name: what "last row wins" needs among equal times.

    Only for a table as it is read, before anything else is done with it.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return df.withColumn("seq", place)


def read_results(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None, position: bool = False
) -> DataFrame:
    """Read results; JSON and CSV take a schema, so no pass is spent on inference. ``position`` adds ``seq``."""
    fmt = fmt or format_of(path)
    schema = schema or RESULT_SCHEMA
    reader = spark.read.option("timestampFormat", TIME_FORMAT)
    if fmt == "parquet":
        out = spark.read.parquet(path)
    elif fmt == "json":
        out = reader.schema(schema).json(path)
    elif fmt == "csv":
        out = _read_csv(reader, path, schema)
    else:
        raise ValueError(f"unsupported results format: {fmt}")
    return with_position(out) if position else out


def write_results(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: str | None = None, mode: str = "error"
) -> str:
    """Write results in one of the three formats; Parquet is usually split by ``metric_name``."""
    fmt = fmt or format_of(path)
    if fmt not in set(FORMATS.values()):
        raise ValueError(f"unsupported results format: {fmt}")
    if fmt == "csv":
        df = df.withColumns({f.name: F.to_json(f.name) for f in _nested(df.schema)})
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt != "parquet":
        writer = writer.option("timestampFormat", TIME_FORMAT)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path
