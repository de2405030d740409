"""One Spark session for all tests; scratch output goes to pytest's own folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crashgrid.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "4", memory="4g", partitions=4, conf={"spark.checkpoint.dir": f"file://{shared}"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SMALL


@pytest.fixture
def folder(spark):
    from crashgrid.session import new_folder

    return new_folder(spark, "test")
