import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))


@pytest.fixture(scope="session")
def con():
    from compare import duckdb_connection

    return duckdb_connection("/root/testdata/sf0.01")
