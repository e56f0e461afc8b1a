"""The result log as a stream of files: latest rows, throughput and status, kept up to date."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeframe.operators.log import latest_by_cell, status_columns
from gaugeframe.session import cut_lineage


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Log files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_latest(log_stream: DataFrame) -> DataFrame:
    """Newest row per cell; the state keeps the maximum, so a late row never replaces a newer one.

    Run in update or complete mode. State holds one row per cell.
    """
    return latest_by_cell(log_stream)


# ---- the latest rows as a table ----

#: Buckets of a latest table: a trigger rewrites those that its cells fall into, and its list of buckets is this long.
BUCKETS = 64


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which version of each bucket the newest listed trigger (before another one) names."""
    try:
        lists = spark.read.schema("bucket int, version long, trigger long").parquet(f"{path}/lists")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if before is not None:
        lists = lists.filter(F.col("trigger") < before)
    last = lists.agg(F.max("trigger").alias("trigger")).first().trigger
    return {r.bucket: r.version for r in lists.filter(F.col("trigger") == last).collect()} if last is not None else {}


def _files(path: str, versions: dict[int, int], buckets: Iterable[int]) -> list[str]:
    return [f"{path}/data/version={versions[b]}/bucket={b}" for b in buckets if b in versions]


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``start_latest`` keeps: one row per cell, as of the last finished trigger."""
    versions = _versions(spark, path)
    files = _files(path, versions, sorted(versions))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def start_latest(log_stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep a table of the newest row per cell up to date below ``path``.

    A trigger gets the cells that changed, merges them with the files of their hash buckets, writes those buckets as a new
    version and then, in one file, the list of all buckets' versions. Readers follow the newest list, so they see a trigger whole or
    not at all; a trigger that runs again after a failure starts from the list before it and writes the same. Work grows with
    the touched buckets. Versions that no list names any more may be removed once nobody reads them.
    """
    rest = [f.name for f in log_stream.schema if f.name != "cell_id"]
    latest = stream_latest(log_stream)
    schema = latest.schema

    def keep(batch: DataFrame, trigger: int) -> None:
        spark = batch.sparkSession
        changed = cut_lineage(batch.select("cell_id", *rest, F.pmod(F.xxhash64("cell_id"), F.lit(buckets)).cast("int").alias("bucket")))
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())  # no more than there are buckets
        if not touched:
            return
        versions = _versions(spark, path, trigger)
        held = _files(path, versions, touched)
        rows = changed
        if held:
            old = spark.read.schema(schema).parquet(*held)
            rows = changed.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64("cell_id"), F.lit(buckets)).cast("int")))
        # one shuffle by bucket serves both the merge and the files
        merged = rows.repartition("bucket").groupBy("bucket", "cell_id").agg(F.max_by(F.struct(*rest), F.struct("executed_at", "seq")).alias("_row"))
        merged.select("bucket", "cell_id", "_row.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={trigger}")
        listed = sorted({**versions, **dict.fromkeys(touched, trigger)}.items())
        spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/trigger={trigger}")

    return latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)


# ---- throughput ----


def _micros(interval: str) -> Column:
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")


def stream_throughput(
    log_stream: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour"
) -> DataFrame:
    """Completed and failed cells per event-time window: (window_start, completed, failed); append mode emits a window once it is closed.

    A cell counts once in a window, by its newest row there, however often and in whatever order its rows come. A newer row
    that falls behind the window's end by less than ``watermark`` takes the cell out of the window again: it moved before the window
    was closed. So each row is told to the windows that hold it and to those it takes its cell out of. State is a row for each
    open window and cell; it goes when the watermark passes the window. Rows without a time are left out.
    """
    step, size, late = _micros(slide or window), _micros(window), _micros(watermark)
    at = F.unix_micros("executed_at")
    floor = lambda x: F.floor(x / step) * step
    starts = F.sequence(floor(at - size - late) + step, floor(at), step)
    timed = log_stream.filter(F.col("executed_at").isNotNull())
    told = timed.select("cell_id", "status", "executed_at", "seq", at.alias("_at"), F.explode(starts).alias("_start"))
    inside = F.col("_at") < F.col("_start") + size
    # the last step of its span stands for a window, so that both end together
    step_at = F.timestamp_micros(F.col("_start") + size - step).alias("_step_at")
    told = told.select("cell_id", "status", F.when(inside, F.struct("executed_at", "seq")).alias("_order"), inside.alias("_inside"), step_at)
    cells = (
        told.withWatermark("_step_at", watermark)
        .groupBy(F.window("_step_at", slide or window).alias("_open"), "cell_id")
        .agg(F.max_by("status", "_order").alias("status"), F.bool_and("_inside").alias("_stays"))
    )
    return (
        cells.filter("_stays").groupBy("_open")
        .agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
        .select(F.timestamp_micros(F.unix_micros("_open.end") - size).alias("window_start"), "completed", "failed")
    )


# ---- status ----

#: Buckets of cells whose newest rows lie in one state. A trigger reads and writes the states of the buckets it touches.
STATE_BUCKETS = 1024
BUCKET_STATE = "held binary"
HELD = ["cell_id", "status", "at", "seq"]
CHANGE = "completed long, failed long, first_at long"
EARLIEST = -(1 << 63)


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The newest row of each cell, of equals the one that stands first."""
    order = np.lexsort((-np.arange(len(rows)), rows["seq"], rows["at"]))[::-1]
    return rows.iloc[order].drop_duplicates("cell_id")


def _change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What new rows of a bucket's cells change: a cell enters one count, and leaves another if it was counted before."""
    old = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else None
    newest, touched = old, None
    for frame in frames:
        first = frame.groupby("cell_id", dropna=False, sort=False, as_index=False).agg(first_at=("at", "min"))
        if touched is not None:
            first = pd.concat([touched, first]).groupby("cell_id", dropna=False, sort=False, as_index=False).agg(first_at=("first_at", "min"))
        touched = first
        newest = _newest(frame[HELD] if newest is None else pd.concat([newest, frame[HELD]]))
    if touched is None:
        return
    table = pa.Table.from_pandas(newest, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    told = touched.merge(newest[["cell_id", "status"]], "left", "cell_id")
    before = np.full(len(told), None) if old is None else touched.merge(old[["cell_id", "status"]], "left", "cell_id")["status"].to_numpy()
    change = {s: (told["status"].to_numpy() == s).astype("int64") - (before == s).astype("int64") for s in ("completed", "failed")}
    yield pd.DataFrame({**change, "first_at": told["first_at"].to_numpy()})


def stream_changes(log_stream: DataFrame) -> DataFrame:
    """(completed, failed, first_at) for each cell with new rows: +1, 0 or -1 for both counts, and the least time of the new rows.

    State is the status, time and position of a cell's newest row, those of a hash bucket of cells together; a late row changes nothing.
    Update mode.
    """
    slim = log_stream.select(
        F.pmod(F.xxhash64("cell_id"), F.lit(STATE_BUCKETS)).alias("bucket"),
        "cell_id", "status", F.coalesce(F.unix_micros("executed_at"), F.lit(EARLIEST)).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(EARLIEST)).alias("seq"),
    )
    return slim.groupBy("bucket").applyInPandasWithState(_change, CHANGE, BUCKET_STATE, "update", GroupStateTimeout.NoTimeout)


def start_status(log_stream: DataFrame, expected: DataFrame, now: str, out_path: str, checkpoint: str):
    """Write the experiment status after every trigger, below ``out_path`` under the trigger's id.

    A trigger is handed the changes of the cells with new rows, never the table of all cells; their sums are added to the totals that
    the last trigger left in its own row. A trigger that runs again starts from the same totals.
    """
    size = expected.select("cell_id").distinct().agg(F.count(F.lit(1)).alias("expected"))

    def report(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = F.when(F.col("first_at") != EARLIEST, F.col("first_at"))
        change = batch.agg(F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.min(known).alias("first_at"))
        totals = change
        try:
            before = spark.read.schema(f"{CHANGE}, trigger long").parquet(f"{out_path}/totals").filter(F.col("trigger") < epoch)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            last = before.groupBy().agg(F.max_by(F.struct("completed", "failed", "first_at"), "trigger").alias("t")).select("t.*")
            totals = change.union(last)
        totals = totals.agg(
            F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.min("first_at").alias("first_at")
        )
        totals.write.mode("overwrite").parquet(f"{out_path}/totals/trigger={epoch}")
        own = spark.read.schema(CHANGE).parquet(f"{out_path}/totals/trigger={epoch}")
        counts = own.select("completed", "failed", F.timestamp_micros("first_at").alias("started_at"))
        status_columns(counts.join(F.broadcast(size)), now).write.mode("overwrite").parquet(f"{out_path}/status/trigger={epoch}")

    return stream_changes(log_stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(report)


def read_status(spark: SparkSession, out_path: str) -> DataFrame:
    """The status that the last trigger wrote."""
    rows = spark.read.parquet(f"{out_path}/status")
    last = rows.agg(F.max("trigger").alias("trigger"))
    return rows.join(F.broadcast(last), "trigger").drop("trigger")
