from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millpond.session import build, scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return scratch(spark, "test")
