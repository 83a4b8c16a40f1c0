import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from repolith.session import local_session

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = local_session(cpus=8, scratch=tmp)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
