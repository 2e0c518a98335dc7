"""Every registered query outside the numbered ones against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from matterloom import plans

from .conftest import SF

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    if name not in plans.ORACLES:
        assert rows
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == order
    assert rows == sorted((tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall()), key=repr)
