import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame in a few partitions, with a column nobody asked for under a name operators use."""

    def make(rows, schema, partitions=3):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "1 AS n", "'x' AS key", "2 AS fp", "'y' AS d").repartition(partitions)

    return make
