import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from partmill.session import session
    s = session("partmill-tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
