import glob
import os

import pytest

import __spark_entry__ as entry
from scriptorium.llm import catalog

QUERIES, ORACLE = catalog.collect()
FOUND = {
    "p1_found": ["src", "id_a", "id_b"], "p2_found": ["src", "record_id"], "p3_found": ["src", "record_id", "para_no", "kind"], "p4_found": ["group_id", "record_id"], "p5_found": ["result_id", "defect"],
    "p6_found": ["eval_table", "eval_id", "pair_id"], "p7_found": ["src", "record_id", "sentence_no", "end_pos"], "p8_found": ["doc_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "line_no", "lang"],
}
needs_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_is_distinct(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    if name in FOUND:
        assert df.columns == FOUND[name]
        rows = df.collect()
        assert len(rows) == len(set(rows))
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(map(tuple, entry.queries()[name](spark, sf).select(*cols).collect())) == sorted(cur.fetchall())
