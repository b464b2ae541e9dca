import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallystone.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
