import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from palabre.session import build_session, ship

    s = build_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "2g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in sorted(Path(DATA).iterdir()):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return c


def canonical(rows, columns):
    """Rows as sorted tuples, columns by name, numbers rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or x != x:
            return None
        if isinstance(x, bool):
            return str(x)
        try:
            return round(float(x), 5)
        except (TypeError, ValueError):
            return str(x)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)
