import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from sievewright.session import local_session

    few = {"spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "3"}
    return local_session(8, "tests", **few)
