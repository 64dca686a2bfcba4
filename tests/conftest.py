import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    return local_session("tests", cpus=4, partitions=4)


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame, columns):
    """Rows as sorted tuples, nulls as None and numbers without their width."""
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, str)) and pd.isna(v)):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture
def same_rows():
    def check(got, want):
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
