import os
import signal
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def in_time():
    """A test that does not end fails after so many seconds, so that the others still run."""

    def stop(*_):
        raise TimeoutError("the test did not end in time")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(int(os.environ.get("TEST_SECONDS", "400")))
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
