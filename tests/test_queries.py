import glob
import os

import pytest

import __spark_entry__ as entry
from scriptorium.plans import catalog


def plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    cursor = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda it: sorted(repr(tuple(map(plain, r))) for r in it)
    want = cursor.fetchall()
    assert rows(got.select(*order).collect()) == rows([tuple(r[names.index(c)] for c in order) for r in want])


def test_entry_and_cli(spark, sf):
    from scriptorium import cli, sql

    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    assert entry.entry(spark).count() > 0
    assert "[S1]" in cli.main(["--data", sf, "--question", "Who bears the cost of the formwork?", "--mode", "bm25"], spark)
    with pytest.raises(SystemExit):
        cli.parse(["--data", sf, "--question", "x", "--top-k", "0"])
    assert sql.query(spark, sf, "SELECT count(*) AS n FROM chunks").first().n > 0
