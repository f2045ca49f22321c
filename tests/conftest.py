import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.driver.extraJavaOptions": f"-Dderby.system.home={base}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
