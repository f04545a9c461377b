import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagelattice.session import local_session

    return local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows_of(frame):
    """A pandas frame's rows as sorted text, columns by name, floats to six places."""

    def one(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v

    frame = frame[sorted(frame.columns)]
    cols = [[one(v) for v in frame[c].astype(object)] for c in frame.columns]
    cols = [[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in c] for c in cols]
    return sorted(map(str, zip(*cols)))
