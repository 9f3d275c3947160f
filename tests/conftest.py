import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemill.session import local_session  # noqa: E402


# Started on import, as test modules build column expressions at their top level.
SESSION = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def values(spark):
    """Evaluate an expression over a list of values of one column ``x``."""

    def run(expr, items, dtype="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {dtype}")
        rows = df.select("i", expr.alias("y")).collect()
        return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
