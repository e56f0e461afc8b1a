"""Deterministic draws.

Every draw is a pure function of (seed, keys, iteration, slot) through md5, so retries, executor
loss and repartitioning cannot change a result, and any engine with md5 can repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Draws made by one row before it is split further; bounds the array behind ``explode``.
CHUNK = 4096
# One md5 gives two draws of 15 hex digits (60 bits), so the modulo bias stays below n / 2^60.
HEX_DIGITS = 15
SECOND_AT = 17
# Draws that are sorted and packed at once (32 MB of longs), and digests taken at once.
RUN = 1 << 22
DIGESTS = 1 << 16
# Largest step of a byte of packed draws, which is not a draw itself.
STEP = 255


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by a bar."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1) from the first 32 bits of the digest."""
    return (hex_to_long(F.substring(digest(*parts), 1, 8)) + 0.5) / F.lit(2.0**32)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box-Muller from the two halves of one digest."""
    h = digest(*parts)
    u1 = (hex_to_long(F.substring(h, 1, 8)) + 0.5) / F.lit(2.0**32)
    u2 = (hex_to_long(F.substring(h, 9, 8)) + 0.5) / F.lit(2.0**32)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def dense_index(
    df: DataFrame, id_cols: list[str], by: list[str] | None = None, seed: int | None = None, limit: int | None = None
) -> DataFrame:
    """Add ``idx``: 0-based position within ``by``, ordered by md5 of (seed and) the id, then the id.

    Positions come from per-bucket counts (at most 65,536 buckets by digest prefix) plus the rank
    inside the bucket, so no task ever sorts a whole group and a hot ``by`` key is spread evenly.
    With ``limit`` only the first positions are kept, and buckets beyond them are dropped before the
    rows are shuffled.
    """
    by = by or []
    key = [F.col(c) for c in id_cols]
    keyed = df.withColumn("_h", digest(*([F.lit(seed)] if seed is not None else []), *key)).withColumn(
        "_b", F.substring("_h", 1, 4)
    )
    sizes = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_start"))
    if limit is not None:
        starts = starts.filter(F.col("_start") < limit)
    if not by:
        # one row per digest prefix: 65,536 at most
        starts = F.broadcast(starts)
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *id_cols)
    placed = (
        keyed.join(starts, [*by, "_b"])
        .withColumn("idx", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_h", "_b", "_start")
    )
    return placed if limit is None else placed.filter(F.col("idx") < limit)


def index_draws(
    groups: DataFrame, by: list[str], n_iterations: int, seed: int | Column, size_col: str = "n"
) -> DataFrame:
    """Draw ``n`` indices out of ``0..n-1`` with replacement, ``n_iterations`` times per group.

    ``groups`` has one row per key with the population size; the result has the keys,
    ``iteration`` and ``idx``. Work is cut into chunks that are spread over the cluster before
    they are expanded, so one group of any size uses every core.
    """
    spark = groups.sparkSession
    slots = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    half = CHUNK // 2
    n = F.col(size_col)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    chunks = (
        groups.filter(n > 0)
        .withColumn("_seed", seed.cast("string"))
        .withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iterations - 1))))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / CHUNK))))
        # an explicit count keeps adaptive execution from folding these tiny rows into one task
        .repartition(slots, *by, "iteration", "_chunk")
    )
    first = F.col("_chunk") * half
    last = F.least(first + half, F.floor((n + 1) / 2)) - 1
    pairs = chunks.withColumn("_pair", F.explode(F.sequence(first, last)))
    hashed = pairs.withColumn("_h", digest(F.col("_seed"), *by_cols(by), F.col("iteration"), F.col("_pair")))
    # numbers are read inside the array, so that a later filter on idx does not read them again
    number = lambda at: hex_to_long(F.substring("_h", at, HEX_DIGITS)) % n
    full = F.col("_pair") * 2 + 1 < n
    drawn = F.when(full, F.array(number(1), number(SECOND_AT))).otherwise(F.array(number(1)))
    return hashed.select(*by, "iteration", F.explode(drawn).alias("idx"))


def by_cols(by: list[str]) -> list[Column]:
    return [F.col(c) for c in by]


def _run_draws(key: bytes, first: int, last: int, n: int) -> np.ndarray:
    """The draws of ``index_draws`` in the pairs from ``first`` until ``last``."""
    drawn = []
    for start in range(first, last, DIGESTS):
        pairs = range(start, min(start + DIGESTS, last))
        raw = b"".join([hashlib.md5(b"%s%d" % (key, p), usedforsecurity=False).digest() for p in pairs])
        drawn.append((np.frombuffer(raw, ">u8") >> 64 - 4 * HEX_DIGITS).astype(np.int64) % n)
    return np.concatenate(drawn)[: n - 2 * first]


def pack_steps(sorted_at: np.ndarray) -> bytes:
    """Ascending places as the steps between them, a byte each; a step of ``STEP`` or more is led by bytes ``STEP``."""
    whole, rest = np.divmod(np.diff(sorted_at, prepend=0), STEP)
    ends = np.cumsum(whole + 1)
    steps = np.full(int(ends[-1]), STEP, np.uint8)
    steps[ends - 1] = rest
    return steps.tobytes()


def unpack_steps(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != STEP]


def packed_draws(groups: DataFrame, by: list[str], n_iterations: int, seed: int, block_bits: int) -> DataFrame:
    """The draws of ``index_draws``, packed by block of indices: (by…, iteration, _block, _steps).

    A run of an iteration's draws is sorted, so that a draw takes little more than a byte in a shuffle. Groups (by…, n) have no
    null keys.
    """
    spark = groups.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = (
        groups.filter("n > 0")
        .withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iterations - 1))))
        .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
        .repartition(slots, *by, "iteration", "_run")
        .withColumn("_key", F.concat(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in by], F.col("iteration").cast("string")), F.lit("|")))
    )
    kept = [*by, "iteration"]
    schema = groups.select(*by).schema.add("iteration", "integer").add("_block", "long").add("_steps", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (key, run, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_run", "n")), strict=True)):
                first = run * (RUN // 2)
                drawn = np.sort(_run_draws(key.encode(), first, min(first + RUN // 2, (n + 1) // 2), n))
                block = drawn >> block_bits
                starts = np.flatnonzero(np.diff(block, prepend=-1))
                steps = [pack_steps(at) for at in np.split(drawn & ((1 << block_bits) - 1), starts[1:])]
                same = pa.array(np.full(len(starts), row))
                columns = [batch.column(c).take(same) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block[starts]), pa.array(steps, pa.binary())], schema.names)

    return runs.mapInArrow(pack, schema)
