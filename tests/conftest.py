from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "riskloom-tests", "local[8]", 8,
        {
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(shared),
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": str(shared / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = os.environ.get("RISKLOOM_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.001"
