import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        f = f"{SF}/{name}.parquet"
        c.execute(f"create view {name} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def canonical(frame) -> list[tuple]:
    import numpy as np
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (float, np.floating)):
            return str(int(v)) if float(v).is_integer() else repr(round(float(v), 9))
        return str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(one(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)
