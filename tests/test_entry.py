import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

DATA = pathlib.Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_against_sql(spark):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    q, sql = entry.queries(), entry.oracle_sql()
    assert entry.entry(spark).count() > 0
    for name in ("agg_group", "join_4way", "win_rank", "sql_frontend_flagship", "ctx_rrf", "graph_related_khop", "p1_found"):
        mine = q[name](spark, str(DATA))
        theirs = con.execute(sql[name])
        cols = [x[0] for x in theirs.description]
        assert sorted(cols) == sorted(mine.columns), name
        show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(show(r[c]) for c in cols) for r in mine.collect()) == sorted(tuple(show(v) for v in r) for r in theirs.fetchall()), name
