from __future__ import annotations

import os
import sys
import time
from datetime import datetime, timezone
from pathlib import Path

os.environ["TZ"] = "UTC"
time.tzset()

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

AS_OF = datetime(2024, 1, 16, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    from wardline.session import build

    session = build(
        "wardline-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def world(spark):
    from tests.scenario import world

    return world(spark, AS_OF)


@pytest.fixture(scope="session")
def now():
    """A moment just after the scenario begins: even the two-second grant is alive."""
    from pyspark.sql import functions as F

    return F.lit("2024-01-16 00:00:01").cast("timestamp")


@pytest.fixture(scope="session")
def keys(spark):
    """Two signing keys as (kid, secret_hex)."""
    import hashlib

    from tests.helpers import frame

    rows = [("default", hashlib.sha256(b"one").hexdigest()), ("k2", hashlib.sha256(b"two").hexdigest())]
    return frame(spark, rows, "kid string, secret_hex string")
