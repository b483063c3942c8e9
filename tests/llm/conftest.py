import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of rows, with columns that clash with names the operators use."""

    def build(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1 AS score", "'x' AS fp", "2 AS size", "'y' AS bucket") if extra else df

    return build
