import pytest

from ambry.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Small DataFrames from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
