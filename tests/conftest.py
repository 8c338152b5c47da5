import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from dayloom.session import drop_scratch, local_session

    s = local_session(4, shuffle=4, memory="6g")
    yield s
    drop_scratch(s)
    s.stop()


@pytest.fixture
def make(spark):
    """Panel from (day number or ISO text, entity, label, metric[, activity]) rows."""
    from dayloom.panel import PANEL

    def build(rows, site="main"):
        out = []
        for r in rows:
            day, entity, label, metric = r[:4]
            day = dt.date(2024, 1, day) if isinstance(day, int) else dt.date.fromisoformat(day)
            activity = float(r[4]) if len(r) > 4 else 10.0
            out.append((site, day, entity, label, activity, None if metric is None else float(metric), 1, 2))
        return spark.createDataFrame(out, PANEL)

    return build
