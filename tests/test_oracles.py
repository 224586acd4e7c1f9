"""Every registered query against its DuckDB oracle on the smallest tables, where they are there."""

import glob
import os
from decimal import Decimal

import pytest

from ledgerloom import registry

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return str(v.normalize()) if v else "0"
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = con.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted(repr(tuple(_plain(x[c]) for c in order)) for x in rows)
    assert got == sorted(repr(tuple(_plain(x[names.index(c)]) for c in order)) for x in r.fetchall())
