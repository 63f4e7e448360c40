import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark import build_session

    s = build_session("local[4]", 2, "tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
