import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from wirepost.plans.session import build
    s = build("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
