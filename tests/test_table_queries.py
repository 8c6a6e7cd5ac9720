"""Queries of sources, sinks and smaller operators against their SQL."""

import duckdb
import pytest

from mossgrid.plans import table_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        out.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", table_queries.QUERIES)
def test_equals_sql(spark, con, name):
    got, want = table_queries.QUERIES[name](spark, SF), con.sql(table_queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda r: sorted(map(tuple, r), key=repr)
    a, b = rows(got.select(columns).collect()), rows(want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b and a


def test_wall_to_wall_ties(spark, tmp_path):
    """Plots on either side of a pixel at equal distances, and ids that pixels have too."""
    con = duckdb.connect()
    con.execute(f"copy (select range as c_custkey, (range % 25)::int as c_nationkey, ((range * 7919) % 90001)::double / 10 as c_acctbal from range(300)) to '{tmp_path}/customer.parquet' (format parquet)")
    con.execute(f"copy (select 599 - range as s_suppkey, ((range // 2) % 25)::int as s_nationkey, (((range // 2) * 7919) % 90001)::double / 10 + (range % 2 * 2 - 1) * (1 + range // 2 % 5) * 0.37 as s_acctbal from range(600)) to '{tmp_path}/supplier.parquet' (format parquet)")
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    columns = ["row", "col", "rank", "neighbor_id", "distance"]
    got = sorted(map(tuple, table_queries.wall_to_wall(spark, str(tmp_path)).select(columns).collect()))
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({table_queries.ORACLE_SQL['wall_to_wall']})").fetchall())
