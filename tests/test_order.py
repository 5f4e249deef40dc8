"""The order in which ordered queries give their rows, against the other engine's."""

import duckdb
import pytest

from inventra.plans import catalogue

from .test_catalogue import _TABLES

_DRILLS = sorted(n for n in catalogue.QUERIES if n.startswith(("r1_", "r2_", "r3_", "r4_")))
_SORTED = {"l1_pending": "priority_score DESC, id", "l2_page": "id DESC, response_id DESC NULLS LAST", "l4_keyset": "id", "l5_duplicate_chunk": "id"} | dict.fromkeys(_DRILLS, "file_size DESC, id")


@pytest.mark.parametrize("name", sorted(_SORTED))
def test_order(spark, data, name):
    con = duckdb.connect()
    for table in _TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    keys = [k.split()[0] for k in _SORTED[name].split(", ")]
    got = [tuple(r[k] for k in keys) for r in catalogue.QUERIES[name](spark, data).collect()]
    assert got == con.execute(f"SELECT {', '.join(keys)} FROM ({catalogue.ORACLES[name]}) ORDER BY {_SORTED[name]}").fetchall()
