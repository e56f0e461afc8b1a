"""The same result at any partitioning and row order."""

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import log as C
from gaugeframe.operators import ranking as R
from gaugeframe.operators import resampling as H
from gaugeframe.operators import variance as V
from gaugeframe.plans.registry import rounded
from gaugeframe.plans.views import cells_close, log

SF = "/root/testdata/sf0.001"

OPERATORS = {
    "components": (cells_close, lambda df: V.variance_components(df)),
    "bootstrap": (cells_close, lambda df: R.bootstrap_all_facets(df, n_bootstrap=10)),
    "subsets": (cells_close, lambda df: H.task_subsets(df, [10, 40], 10)),
    "interval": (cells_close, lambda df: H.bootstrap_ci(df, "metric_value", ["cell_id"], n_bootstrap=10)),
    "counts": (cells_close, lambda df: H.bootstrap_ci(df, "metric_value", by=["model"], n_bootstrap=10)),
    "latest": (log, lambda df: C.latest_by_cell(df).drop("scores")),
    "fingerprint": (log, lambda df: C.table_fingerprint(df.drop("scores"))),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_partitioning(spark, name):
    view, operator = OPERATORS[name]
    df = view(spark, SF)

    def result(rows):
        return sorted(map(str, rounded(operator(rows)).collect()))

    want = result(df.repartition(1))
    assert result(df.repartition(16)) == want
    assert result(df.orderBy(F.rand(3))) == want


def test_one_hot_key(spark):
    """A third of all rows under one cell and one model."""
    base = log(spark, SF)
    hot = base.withColumn("cell_id", F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.col("cell_id")))
    got = C.latest_by_cell(hot).filter("cell_id = 'hot'").first()
    want = base.filter("seq % 3 = 0").orderBy(F.desc("executed_at"), F.desc("seq")).first()
    assert got.seq == want.seq
