import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hearsay.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Collect a DataFrame as sorted plain tuples."""

    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect


@pytest.fixture(scope="session")
def catalog(spark):
    from hearsay.schemas import ENTITIES

    return spark.createDataFrame(
        [
            ("e1", "Taylor Swift", "Taylor Swift", "person", True, ["T-Swift", "Tay"], 1),
            ("e2", "Ryan Reynolds", "Ryan Reynolds", "person", True, [], 2),
            ("e3", "Ryan Gosling", "Ryan Gosling", "person", True, ["Gos"], 3),
            ("e4", "Tay Zonday", "Tay Zonday", "person", True, ["Tay"], 4),
        ],
        ENTITIES,
    )
