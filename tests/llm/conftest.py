import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame of a DDL schema."""
    from factorloom.llm.common import prepare

    prepare(spark)
    return lambda rows, schema: spark.createDataFrame(rows, schema)
