"""All registered queries."""

from gaugeframe.plans import data_queries, regression_queries, statistics_queries  # noqa: F401
from gaugeframe.plans.registry import ORACLES, QUERIES  # noqa: F401
