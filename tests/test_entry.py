import pytest

import __spark_entry__ as E
from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "row_id" in df.columns


def test_every_sql_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["features_b", "null_profile", "global_position", "outlier_downweight",
                                  "row_stats", "policy_p3", "attach_predictions", "wide_profile"])
def test_query_matches_duckdb_at_sf0001(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["events", "lineitem", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(repr(r[i]) for i in order) for r in rows)

    assert norm([tuple(r) for r in sdf.collect()], sdf.columns) == norm(res.fetchall(), cols)
