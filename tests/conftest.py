import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # A session zone with daylight saving: no result may depend on it.
    session = build_session(
        "local[8]", 4, "tests",
        {
            "spark.sql.session.timeZone": "America/New_York",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-tests-"),
            "spark.driver.memory": "4g",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "97",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
