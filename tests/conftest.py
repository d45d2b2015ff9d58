from __future__ import annotations

import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

os.environ["TZ"] = "UTC"
time.tzset()
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    os.environ["PYTHONPATH"] = os.pathsep.join(sys.path)
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "/tmp/attesto-warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
