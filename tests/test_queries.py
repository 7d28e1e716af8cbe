"""Every grid-relational query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from gridloom import catalog
from gridloom.plans import pde_queries

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = canon(df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows
    if name in catalog.oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == canon(con.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(pde_queries.GOLDEN))
def test_fixed_problems(spark, con, name):
    df = pde_queries.GOLDEN[name](spark, SF)
    columns = sorted(df.columns)
    rows = canon(df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows
    if name in pde_queries.CLOSED:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == canon(con.sql(f"SELECT {quoted} FROM ({pde_queries.CLOSED[name]})").fetchall())


def test_queries_read_the_tables(spark):
    """No query has a result where there are no tables."""
    for name, run in catalog.queries().items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            run(spark, "/nowhere").collect()
            pytest.fail(name)


def test_entry_without_the_training_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("gridloom.llm", "corpus_pipeline") else real(n, *a))
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
