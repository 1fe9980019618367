"""Every registered track query runs, and equals its SQL in DuckDB."""

import duckdb
import numpy as np
import pytest
from motiontab.plans import queries_linking, queries_long, queries_more, queries_tables  # noqa: F401
from motiontab.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
#: Model fits; tests/test_learning.py holds their operators against planted tables.
FITS = {"g12_forest_importance", "g16_mixture"}


def text(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return f"{value + 0.0:.6g}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted("|".join(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    order = [found.columns.index(c) for c in sorted(found.columns)]
    assert sorted(found.columns) == sorted(df.columns)
    assert rows == sorted("|".join(text(r[k]) for k in order) for r in found.fetchall())
