from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from coursemill import Store  # noqa: E402
from coursemill.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def store(spark):
    return Store(spark)


@pytest.fixture(scope="session")
def shop(spark):
    from checks.derive import shop_from

    return shop_from(spark, SMALL)
