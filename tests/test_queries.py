"""Every registered query of the core runs on the small tables and agrees with its SQL."""

import datetime
import math
import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.8g}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalog.ORACLES:
        r = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
