from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g --conf spark.ui.enabled=false pyspark-shell")
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from emberlog.session import session

    out = session("local[4]", 4)
    out.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture
def log(tmp_path):
    """Write lines to a file and give its path."""

    def write(text: str, name: str = "app.log") -> str:
        path = tmp_path / name
        path.write_text(text, encoding="utf-8", newline="")
        return str(path)

    return write
