import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelforge.session import BROADCAST_ROWS_KEY, GROUP_ROWS_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Force the block layouts by calling every group and table too large."""
    from panelforge.operators.ordered import forget_sizes

    forget_sizes()
    spark.conf.set(GROUP_ROWS_KEY, "40")
    spark.conf.set(BROADCAST_ROWS_KEY, "5")
    yield
    spark.conf.unset(GROUP_ROWS_KEY)
    spark.conf.unset(BROADCAST_ROWS_KEY)
    forget_sizes()
