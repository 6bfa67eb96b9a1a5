import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from waymesh.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{shared}/checkpoints")
    yield session
    session.stop()
