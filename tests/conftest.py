import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passagemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a column expression over literal rows of one schema."""

    def run(rows, schema, column):
        frame = spark.createDataFrame(
            [(i, *row) for i, row in enumerate(rows)], f"_i INT, {schema}")
        return [r[0] for r in frame.select(column.alias("v"), "_i").orderBy("_i").collect()]

    return run
