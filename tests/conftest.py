import os

import pytest

from gaugeframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "gaugeframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    # tiny frames: compiling each plan costs more than interpreting it
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
