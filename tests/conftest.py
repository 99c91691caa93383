import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("checkpoints")
    s = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(root), "spark.log.level": "ERROR"},
    )
    yield s
    s.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")
