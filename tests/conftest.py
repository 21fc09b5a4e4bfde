import os

import pytest

from marginalia.session import build_session, ship_packages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    ship_packages(session, os.path.join(ROOT, "marginalia"), os.path.join(ROOT, "checks"))
    yield session
    session.stop()
