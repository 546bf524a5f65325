"""The radius graph of accounts names every pair of rows, copies included."""

import duckdb
import pytest

from labelweave.operators import radius
from labelweave.plans import registry


@pytest.mark.parametrize("copies", [1, 4])
def test_every_pair_of_rows_is_named(spark, tmp_path, copies):
    rows = [(k + 100 * i, x, n) for k, x, n in [(1, 0.0, 3), (2, 100.0, 3), (5, 250.0, 3), (7, 0.0, 4), (8, 900.0, 3)] for i in range(copies)]
    spark.createDataFrame([*rows, (9, None, 3)], "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["e12_radius_graph"](spark, str(tmp_path))
    assert found.columns == ["src", "dst", "dist"]
    found = [tuple(r) for r in found.collect()]
    full = {(a, b) for a, x, n in rows for b, y, m in rows if a < b and ((x - y) ** 2 / 1e4 + (20 * (n - m)) ** 2) ** 0.5 <= 2.5}
    assert len(found) == len(full) and {r[:2] for r in found} == full
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet') WHERE c_acctbal IS NOT NULL")
    assert sorted(con.execute(registry.ORACLES["e12_radius_graph"]).fetchall()) == sorted(found)


@pytest.mark.parametrize("lot_rows", [1, 3, 1000])
def test_lots_of_any_size_give_the_same_pairs(spark, lot_rows):
    members = [(k, k % 3, 7 if k % 3 == 0 else 6) for k in range(19)] + [(3, 0, 7), (None, 1, 6)]
    edges = spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, dist double")
    found = radius.row_pairs(edges, spark.createDataFrame(members, "row_id long, point long, weight long"), lot_rows).collect()
    ids = [(k, p) for k, p, _ in members if k is not None]
    wanted = [(a, b, 0.0 if p == q else 0.5) for a, p in ids for b, q in ids if a < b and (p == q or {p, q} == {0, 1})]
    assert sorted(map(tuple, found)) == sorted(wanted)
