"""The radius graph of accounts: pairs of distinct vectors, and copies as members."""

import duckdb
import pytest

from labelweave.plans import registry

LINKS = [(1, 2, 1.0), (1, 5, 2.5), (2, 5, 1.5)]


@pytest.mark.parametrize("copies", [1, 4])
def test_copies_are_members_not_pairs(spark, tmp_path, copies):
    rows = [(k + 100 * i, x, n) for k, x, n in [(1, 0.0, 3), (2, 100.0, 3), (5, 250.0, 3), (7, 0.0, 4), (8, 900.0, 3)] for i in range(copies)]
    rows += [(9, None, 3)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    found = [tuple(r) for r in registry.QUERIES["e12_radius_graph"](spark, str(tmp_path)).collect()]
    assert sorted(r[:3] for r in found if not r[3]) == LINKS
    assert sorted(r[:3] for r in found if r[3]) == sorted((k, k + 100 * i, 0.0) for k in (1, 2, 5, 7, 8) for i in range(1, copies))
    # Members stand for pairs: every link of two rows is one of their first rows, or they have the same one.
    first = {r[1]: r[0] for r in found if r[3]}
    near = {(r[0], r[1]) for r in found if not r[3]}
    full = {(a, b) for a, x, n in rows for b, y, m in rows if a < b and None not in (x, y) and ((x - y) ** 2 / 1e4 + (20 * (n - m)) ** 2) ** 0.5 <= 2.5}
    ids = [r[0] for r in rows if r[1] is not None]
    spelt = {(a, b) for a in ids for b in ids if a < b and (first.get(a, a) == first.get(b, b) or tuple(sorted((first.get(a, a), first.get(b, b)))) in near)}
    assert spelt == full
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet') WHERE c_acctbal IS NOT NULL")
    assert sorted(con.execute(registry.ORACLES["e12_radius_graph"]).fetchall()) == sorted(found)
