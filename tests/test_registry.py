"""Every registered query of the engine's own operators against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

from quillon import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(norm(x) for x in r) for r in df.select(columns).collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert Counter(map(repr, rows)) == Counter(map(repr, want))
