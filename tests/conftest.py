import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from variegate.session import get_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("variegate-tests", "local[8]", shuffle_partitions=4,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of named strings."""
    def run(expression, **columns):
        names = ", ".join(f"{name} string" for name in columns)
        df = spark.createDataFrame([tuple(columns.values())], names)
        return df.select(expression.alias("value")).first()["value"]
    return run
