import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from seriesloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[*]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_blocks(spark):
    """Make every group of more than 40 rows count as oversized."""

    def use(rows=40):
        spark.conf.set("seriesloom.rowsPerTask", str(rows))

    yield use
    spark.conf.unset("seriesloom.rowsPerTask")
