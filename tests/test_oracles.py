"""Every registered query against its SQL, on whole tables."""

import pytest

from gaugeframe.plans import catalog
from tests.compare import check, duck

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# closed forms that need every model x task pair, which the smallest tables do not have
NEEDS_MEDIUM = {"f19_random_intercept_lmm"}


@pytest.fixture(scope="module")
def connections():
    return {d: duck(d) for d in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, connections, name):
    sf = MEDIUM if name in NEEDS_MEDIUM else SMALL
    rows, expected = check(spark, connections[sf], sf, name)
    assert rows > 0 or expected == 0
