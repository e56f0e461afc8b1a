"""Main-effects fits over any number of levels: conjugate gradients on the tables of levels and pairs of levels.

The normal equations of a main-effects model are the level counts (diagonal) and the counts of level pairs (the rest), so a product
with the matrix is a join of the pair table with a table of one number per level. No matrix and no vector reaches the
driver; an iteration brings four sums per stratum and fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.session import cut_lineage

TOLERANCE = 1e-18
MOST_ITERATIONS = 1000
NODE = ["key", "f", "l"]


@dataclass(frozen=True)
class Fit:
    """Sum of squares about the mean that a set of facets explains, its rank, and for a wanted row x of the design x'A^-x and x'estimate."""

    explained: float
    rank: int
    scale: float | None = None
    estimate: float | None = None


def both_ways(pairs: DataFrame) -> DataFrame:
    """(key, f, l, g, m, n): every pair of levels from either side."""
    turned = pairs.select("key", F.col("f1").alias("f"), F.col("l1").alias("l"), F.col("f0").alias("g"), F.col("l0").alias("m"), "n")
    return pairs.select("key", F.col("f0").alias("f"), F.col("l0").alias("l"), F.col("f1").alias("g"), F.col("l1").alias("m"), "n").union(turned)


def _beside(vector: DataFrame, edges: DataFrame, columns: list[str], combine) -> DataFrame:
    """For each level the combination of its neighbours' columns, weighted by the pair's count where `combine` sums."""
    values = vector.select(F.col("key"), F.col("f").alias("g"), F.col("l").alias("m"), *columns)
    return edges.join(values, ["key", "g", "m"]).groupBy(*NODE).agg(*[combine(c).alias(f"_{c}") for c in columns])


def components(levels: DataFrame, edges: DataFrame, sets: list[list[str]]) -> dict[tuple[str, int], int]:
    """Connected parts of the levels of each set of facets, by least labels; one round a step of the longest path, few in crossed designs."""
    if not sets:
        return {}
    names = [f"c{i}" for i in range(len(sets))]
    label = F.struct("f", "l")
    inside = {n: F.col("f").isin(*s) if s else F.lit(False) for n, s in zip(names, sets, strict=True)}
    table = cut_lineage(levels.select(*NODE, *[F.when(inside[n], label).alias(n) for n in names]))
    while True:
        near = _beside(table, edges, names, F.min)
        least = {n: F.when(inside[n], F.least(n, F.coalesce(f"_{n}", n))) for n in names}
        moved = F.lit(False)
        for n in names:
            moved = moved | F.coalesce(least[n] != F.col(n), F.lit(False))
        after = table.join(near, NODE, "left").select(*NODE, *[least[n].alias(n) for n in names], moved.alias("_moved"))
        table = cut_lineage(after)
        if not table.filter("_moved").limit(1).count():
            break
        table = table.drop("_moved")
    counts = table.groupBy("key").agg(F.count(F.lit(1)), *[F.countDistinct(n).alias(n) for n in names]).collect()
    return {(r.key, i): r[n] for r in counts for i, n in enumerate(names)}


def fits(levels: DataFrame, pairs: DataFrame, sets: list[list[str]], wanted: Column | None = None) -> dict[tuple[str, int], Fit]:
    """Least squares of every set of facets in every stratum, all in one run of preconditioned conjugate gradients.

    ``levels`` is (key, f, l, n, b): count of a level and sum of its centred values; ``pairs`` is (key, f0, l0, f1, l1, n).
    ``wanted`` marks the levels of a row of the design for which the first set also gives its estimate and scale. The rank adds facets in
    the order of their set: each brings its levels less the connected parts of all facets so far, which is exact for two
    facets, and for more unless one is a combination of others beyond what is connected. Put facets with most levels first.
    """
    edges = cut_lineage(both_ways(pairs))
    runs = [*range(len(sets)), *([len(sets)] if wanted is not None else [])]
    facets = [*sets, *([sets[0]] if wanted is not None else [])]
    inside = [F.col("f").isin(*s) if s else F.lit(False) for s in facets]
    begin = [F.when(inside[k], F.col("b") if k < len(sets) else wanted.cast("double")).otherwise(0.0) for k in runs]
    state = levels.select(
        *NODE, F.col("n").cast("double").alias("n"),
        *[c.alias(f"b{k}") for k, c in enumerate(begin)], *[F.lit(0.0).alias(f"x{k}") for k in runs],
        *[c.alias(f"r{k}") for k, c in enumerate(begin)], *[(c / F.col("n")).alias(f"p{k}") for k, c in enumerate(begin)],
    )
    first: dict[tuple[str, int], float] = {}
    state = cut_lineage(state)
    for _ in range(MOST_ITERATIONS):
        around = _beside(state, edges, [f"p{k}" for k in runs], lambda c: F.sum(F.col("n") * F.col(c)))
        product = [F.when(inside[k], F.col("n") * F.col(f"p{k}") + F.coalesce(f"_p{k}", F.lit(0.0))).otherwise(0.0).alias(f"q{k}") for k in runs]
        state = cut_lineage(state.join(around, NODE, "left").select(*state.columns, *product))
        sums = state.groupBy("key").agg(
            *[F.sum(F.col(f"r{k}") * F.col(f"r{k}") / F.col("n")).alias(f"rr{k}") for k in runs], *[F.sum(F.col(f"p{k}") * F.col(f"q{k}")).alias(f"pq{k}") for k in runs],
            *[F.sum(F.col(f"r{k}") * F.col(f"q{k}") / F.col("n")).alias(f"rq{k}") for k in runs], *[F.sum(F.col(f"q{k}") * F.col(f"q{k}") / F.col("n")).alias(f"qq{k}") for k in runs],
        ).collect()  # four numbers per stratum and fit
        steps, open_ = [], False
        for row in sums:
            step = [row.key]
            for k in runs:
                rr, pq = row[f"rr{k}"], row[f"pq{k}"]
                start = first.setdefault((row.key, k), rr)
                if rr <= TOLERANCE * start or pq <= 0:
                    step += [0.0, 0.0, False]
                    continue
                open_ = True
                alpha = rr / pq
                step += [alpha, max(rr - 2 * alpha * row[f"rq{k}"] + alpha * alpha * row[f"qq{k}"], 0.0) / rr, True]
            steps.append(step)
        if not open_:
            break
        ddl = "key string, " + ", ".join(f"a{k} double, d{k} double, go{k} boolean" for k in runs)
        moved = state.join(F.broadcast(state.sparkSession.createDataFrame(steps, ddl)), "key")
        rest = {k: F.col(f"r{k}") - F.col(f"a{k}") * F.col(f"q{k}") for k in runs}
        state = moved.select(
            *NODE, "n", *[f"b{k}" for k in runs], *[(F.col(f"x{k}") + F.col(f"a{k}") * F.col(f"p{k}")).alias(f"x{k}") for k in runs],
            *[rest[k].alias(f"r{k}") for k in runs],
            *[F.when(F.col(f"go{k}"), rest[k] / F.col("n") + F.col(f"d{k}") * F.col(f"p{k}")).otherwise(0.0).alias(f"p{k}") for k in runs],
        )
    else:
        raise ArithmeticError(f"no convergence in {MOST_ITERATIONS} iterations")
    last = runs[-1]
    told = [F.sum(F.col(f"x{k}") * F.col(f"b{k}")).alias(f"s{k}") for k in runs]
    sizes = [F.count_if(inside[k]).alias(f"k{k}") for k in range(len(sets))]
    found = state.groupBy("key").agg(*told, *sizes, F.sum(F.col("x0") * F.col(f"b{last}")).alias("at")).collect()
    prefixes = list(dict.fromkeys(tuple(s[: i + 1]) for s in sets for i in range(1, len(s))))
    parts = components(levels, edges, [list(p) for p in prefixes])
    out = {}
    for row in found:
        for k, s in enumerate(sets):
            rank = row[f"k{k}"] - sum(parts[(row.key, prefixes.index(tuple(s[: i + 1])))] for i in range(1, len(s))) if s else 1
            extra = (row[f"s{last}"], row["at"]) if k == 0 and wanted is not None else (None, None)
            out[(row.key, k)] = Fit(row[f"s{k}"], rank, *extra)
    return out
