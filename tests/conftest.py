import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from starfold.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}))
