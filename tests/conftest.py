import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lotwise.session import local_session

    s = local_session(cores=4, shuffle_partitions=2, name="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
