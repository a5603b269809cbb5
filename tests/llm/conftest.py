
import pytest


@pytest.fixture
def table(spark):
    """Rows -> DataFrame in two partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
