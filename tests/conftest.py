import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkcorpus.session import build_session

    folder = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="2", spark__checkpoint__dir=str(folder / "shared"), spark__sql__warehouse__dir=str(folder / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
