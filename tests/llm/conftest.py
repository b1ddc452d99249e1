import pytest


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from rows and a schema string; an empty list makes an empty table."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
