"""The log as a stream: late, repeated and moved cells, restarts, and what each trigger is handed."""

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators.log import latest_by_cell
from gaugeframe.plans import data_queries
from gaugeframe.session import scratch_path
from gaugeframe.streaming import log as ST

SCHEMA = "cell_id string, status string, executed_at timestamp, seq long"


def rows(*listed):
    """(cell, status, 'day hour', seq)."""
    return [(c, s, f"2024-01-{at.split()[0]} {at.split()[1]}:30:00" if at else None, n) for c, s, at, n in listed]


@pytest.fixture
def feed(spark):
    path = scratch_path(spark, "feed")

    def add(*listed):
        plain = spark.createDataFrame(rows(*listed), "cell_id string, status string, at string, seq long")
        df = plain.select("cell_id", "status", F.to_timestamp("at").alias("executed_at"), "seq")
        df.coalesce(1).write.mode("append").parquet(path)
        return path

    return add


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def stream(spark, path):
    return ST.read_log_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)


def test_throughput_counts_a_cell_once(spark, feed):
    feed(("a", "failed", "01 10", 1), ("b", "completed", "01 11", 2), ("a", "completed", "01 12", 3), ("a", "completed", "01 12", 3))
    # c comes late but in time; b moves to the next day before the first is closed, d only after it
    feed(("b", "failed", "02 00", 4), ("c", "failed", "01 01", 5), ("d", "completed", "01 20", 6), ("e", "completed", "01 21", 6))
    feed(("d", "completed", "02 02", 7), ("n", "completed", None, 8), ("x", "completed", "05 00", 9))
    feed(("x", "failed", "05 01", 10))
    path = feed(("z", "completed", "01 03", 11), ("y", "completed", "07 00", 12))  # z comes after the first day was closed
    out = scratch_path(spark, "throughput")
    written = ST.stream_throughput(stream(spark, path)).writeStream.outputMode("append").format("parquet").option("path", out)
    finish(written.option("checkpointLocation", scratch_path(spark, "state")))
    got = {str(r.window_start)[:10]: (r.completed, r.failed) for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": (3, 1), "2024-01-02": (1, 1), "2024-01-05": (0, 1)}


def test_throughput_in_sliding_windows(spark, feed):
    path = feed(("a", "completed", "01 10", 1), ("b", "failed", "01 10", 2), ("b", "failed", "01 13", 3))
    feed(("z", "completed", "03 00", 9))
    out = scratch_path(spark, "throughput")
    written = ST.stream_throughput(stream(spark, path), "4 hours", "2 hours", "1 hour").writeStream.outputMode("append").format("parquet").option("path", out)
    finish(written.option("checkpointLocation", scratch_path(spark, "state")))
    got = {str(r.window_start)[11:13]: (r.completed, r.failed) for r in spark.read.parquet(out).collect() if "01-01" in str(r.window_start)}
    # b's row of 13:30 is in 10-14 and 12-16, and later than the end of 08-12 by more than the hour
    assert got == {"08": (1, 1), "10": (1, 1), "12": (0, 1)}


def test_latest_table_after_every_trigger_and_restart(spark, feed):
    out, state = scratch_path(spark, "latest"), scratch_path(spark, "state")
    batches = [
        [(f"c{i}", "failed", "02 10", i) for i in range(40)],
        [("c1", "completed", "03 10", 99), ("c2", "completed", "01 10", 98), ("new", "completed", None, 1)],
        [("c1", "failed", "03 10", 100), ("new", "failed", "01 00", 0)],
    ]
    for n, batch in enumerate(batches):
        path = feed(*batch)
        s = stream(spark, path)
        finish(ST.start_latest(s, out, state, buckets=8))
        got = ST.read_latest(spark, out, ST.stream_latest(s).schema)
        want = latest_by_cell(spark.read.parquet(path))
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.count() == got.select("cell_id").distinct().count() == 40 + (n > 0)
    versions = ST._versions(spark, out)
    assert len(versions) == 8 and len(set(versions.values())) > 1  # untouched buckets keep their files
    # the last trigger runs again, as after a failure between writing and the stream's own commit
    last = max(versions.values())
    assert max(ST._versions(spark, out, last).values()) < last


def test_status_is_handed_changes_only(spark, feed):
    path = feed(*[(f"c{i}", "completed" if i % 2 else "failed", "02 10", i) for i in range(50)])
    expected = spark.createDataFrame([(f"c{i}",) for i in range(60)] + [("c1",)], "cell_id string")
    out, state, count_state = scratch_path(spark, "status"), scratch_path(spark, "state"), scratch_path(spark, "state")
    handed = []

    def run():
        finish(ST.start_status(stream(spark, path), expected, "2024-01-09 00:00:00", out, state))
        changes = ST.stream_changes(stream(spark, path)).writeStream.outputMode("update").option("checkpointLocation", count_state)
        finish(changes.foreachBatch(lambda batch, _: handed.append(sorted((r.completed, r.failed) for r in batch.collect()))))

    run()
    # c0 turns completed, c1's row is late, c50 is new
    feed(("c0", "completed", "03 10", 100), ("c1", "failed", "01 10", 101), ("c50", "failed", "03 10", 102), ("c0", "completed", "03 10", 100))
    run()
    assert [len(h) for h in handed] == [50, 3] and handed[1] == [(0, 0), (0, 1), (1, -1)]
    got = ST.read_status(spark, out).first()
    want = latest_by_cell(spark.read.parquet(path))
    assert (got.expected, got.completed, got.failed) == (60, want.filter("status = 'completed'").count(), want.filter("status = 'failed'").count())
    assert got.elapsed_seconds == pytest.approx(7 * 86400 + 13.5 * 3600)


def test_status_state_lies_in_buckets(spark, feed, monkeypatch):
    """Many cells share a state; nulls, equal rows and cells of one bucket are told apart."""
    monkeypatch.setattr(ST, "STATE_BUCKETS", 8)
    state, handed = scratch_path(spark, "state"), []
    triggers = [
        [(f"c{i}", "completed", "02 10", i) for i in range(300)] + [(None, "failed", "02 10", 1), ("n", "completed", None, None)],
        # equal to the row that is held, later, without a status, and later than no time at all
        [("c0", "failed", "02 10", 0), ("c1", "failed", "02 11", 0), ("c2", None, "02 12", 0), (None, "completed", "03 10", 1), ("n", "failed", "01 10", 1)],
    ]
    for rows_ in triggers:
        changes = ST.stream_changes(stream(spark, feed(*rows_))).writeStream.outputMode("update").option("checkpointLocation", state)
        query = changes.foreachBatch(lambda batch, _: handed.append(sorted((r.completed, r.failed) for r in batch.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    assert [h for h in handed if h] == [[(0, 1)] + [(1, 0)] * 301, [(-1, 0), (-1, 1), (-1, 1), (0, 0), (1, -1)]]


def test_steps_of_the_log_are_written_by_many_tasks(spark, sf_dir):
    """A step is more than one file, and still one trigger."""
    folder, state, sizes, files = scratch_path(spark, "tables"), scratch_path(spark, "state"), [], set()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.option("maxRecordsPerFile", 1000).parquet(f"{folder}/events.parquet")

    def start(log):
        def look(batch, _):
            sizes.append(batch.count())
            files.update(r.f for r in batch.select(F.input_file_name().alias("f")).distinct().collect())

        return log.writeStream.option("checkpointLocation", state).foreachBatch(look).trigger(availableNow=True).start()

    data_queries._arrive(spark, folder, False, start)
    assert len(sizes) == 4 and sum(sizes) == events.count() and len(files) > 4
