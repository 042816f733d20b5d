from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tests.compare import SMALL, oracle


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.autoBroadcastJoinThreshold", "256k").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the same tables as the queries."""
    with oracle(SMALL) as connection:
        yield connection
