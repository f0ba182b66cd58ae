import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle_check import spark_session

    from reviewflow.session import configure

    session = configure(spark_session())
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def t(spark, small):
    from reviewflow.sources.driver_tables import Tables

    return Tables(spark, small)


def rows(df):
    """Rows as sorted tuples."""
    return sorted([tuple(r) for r in df.collect()], key=repr)
