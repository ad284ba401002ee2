import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidecrew.session import local_session

    session = local_session(8, "tests")
    # The test tables are tiny.
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from tidecrew.sources.mapping import benchmark_tables

    return benchmark_tables(spark, SMALL)
