import pytest

from seqloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions, built from a one-row table, to Python values."""

    def run(schema, values, *columns):
        df = spark.createDataFrame([tuple(values)], schema)
        return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    return run
