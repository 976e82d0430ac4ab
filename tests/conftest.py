import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cairnlake.session import get_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("4", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=str)
