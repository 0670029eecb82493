import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_spark

    session = get_spark("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(spark):
    """Keys above 40 rows are split over blocks."""
    from sluice.session import ROWS_PER_BLOCK_CONF

    spark.conf.set(ROWS_PER_BLOCK_CONF, "40")
    yield
    spark.conf.unset(ROWS_PER_BLOCK_CONF)
