import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from keepwell import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("keepwell-tests", master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
