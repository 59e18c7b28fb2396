import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomstone.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session("tests", cpus=4, **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{base}/shared"})
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF
