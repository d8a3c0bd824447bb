import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cairn.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("cairn-tests", "local[4]", 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
