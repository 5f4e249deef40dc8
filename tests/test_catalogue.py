"""Every registered query against its SQL, run by another engine over the same files."""

import duckdb
import pytest

from inventra.plans import catalogue

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in _TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) or hasattr(v, "normalize"):
        return repr(round(float(v), 6))
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted("|".join(map(_norm, r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted("|".join(_norm(r[i]) for i in at) for r in found.fetchall())
