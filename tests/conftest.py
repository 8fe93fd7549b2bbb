import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

T0 = dt.datetime(2024, 11, 1)


@pytest.fixture(scope="session")
def spark():
    from skycast.session import local_session

    session = local_session("tests", "4")
    yield session
    session.stop()


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def by(df, *keys):
    """Rows as dictionaries keyed by the given columns."""
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        out[k[0] if len(k) == 1 else k] = r.asDict()
    return out
