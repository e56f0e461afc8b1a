"""Shards of a global shuffle: two passes over rows, the second in memory-sized buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket must fit in one task's memory, and a small table still keeps some tasks busy.
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 32


def two_pass_shuffle(
    rows: DataFrame, key: list[str], n_shards: int, size: Column, seed: int = 20, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of `rows` with `shard` and `slot` in a uniformly random order; shard row counts differ by one at most.

    Pass one scatters rows by a seeded hash of `key` into ceil(sum of `size` / `bucket_bytes`) buckets. Pass two
    Fisher-Yates shuffles each bucket (Spark's `shuffle` with a seed, over rows first put in hash order, in a partition
    layout that depends on the data alone, so reruns and retries agree). A bucket's first place is the sum of the counts
    before it, so places are gapless over the table; shard s holds places ceil(s * N / n) up to ceil((s + 1) * N / n).

    Null keys are scattered like any value (by the other key columns too); repeated rows are rows of their own; an empty
    table gives an empty result. Columns named `shard` or `slot` in the input are replaced.
    """
    inner = rows.drop("shard", "slot")
    hashed = inner.select(
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in inner.columns]).alias("_row"),
        size.cast("long").alias("_size"),
    )
    n, total = hashed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    # another hash than the exchange's own, or the buckets would miss some partitions
    scattered = hashed.select(F.pmod("_hash", F.lit(buckets)).cast("int").alias("_bucket"), "_hash", "_row")
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per bucket, whose number is bounded by bytes / bucket_bytes
    places = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", first.alias("_first"))
    by_hash = lambda a, b: F.when(a["_hash"] < b["_hash"], -1).when(a["_hash"] > b["_hash"], 1).otherwise(0)
    packed = (
        scattered.repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_hash", "_row")), by_hash).alias("_rows"))
        .sortWithinPartitions("_bucket")  # the draws of a partition follow the order of its buckets
        .select("_bucket", F.shuffle("_rows", seed).alias("_rows"))
    )
    place = F.col("_first") + F.col("_at")
    placed = (
        packed.join(places, "_bucket")
        .select("_first", F.posexplode("_rows").alias("_at", "_item"))
        .select(place.alias("_place"), F.col("_item._row").alias("_row"))
        .withColumn("shard", F.expr(f"cast(_place * {n_shards} div {max(n, 1)} as int)"))
    )
    start = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")  # the first place of the shard
    return placed.select("_row.*", "shard", (F.col("_place") - start).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard. A bucket meets two shards at most, so each task writes few files."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
