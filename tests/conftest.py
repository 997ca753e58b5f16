import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from screenloom.session import build_session, release, ship_package  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cpus="8", shuffle_partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
