"""Every named query of the relational library beside its SQL in DuckDB."""

import duckdb
import pytest

from tools.compare import TABLES, rows_of
from vigilake.plans import catalog

SF = "/root/testdata/sf0.001"
#: With the few rows of the smallest tables.
MAY_BE_EMPTY = {"t12_limit_then_filter", "p21_p15_long_words", "p13_signatures", "j21_j31_recent_threats", "t5_rescan_candidates", "p40_permissions_text", "r5_worker_feed"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, db, name):
    run, sql = catalog.QUERIES[name]
    df = run(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got or name in MAY_BE_EMPTY
    if sql is None:
        return
    done = db.execute(sql)
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, done.fetchall())


def test_flagship_and_guard(spark, monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("vigilake.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("vigilake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(catalog.QUERIES)
