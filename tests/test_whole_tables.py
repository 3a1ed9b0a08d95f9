"""Queries over whole tables, against expected results."""

from loomgraph.plans import tables


def test_cycles_of_all_users(spark):
    steps = [(k, u, k, e) for k, (u, e) in enumerate([(1, "a"), (1, "b"), (1, "a"), (11, "c"), (11, "d"), (2, "c"), (3, "d"), (3, "c")])]
    events = spark.createDataFrame(steps, "event_id long, user_id long, ts long, event_type string")
    got = tables.g3({"events": events}.get)
    assert sorted(r.members for r in got.collect()) == [["a", "b"], ["c", "d"]]


def test_components_of_all_suppliers(spark):
    rows = [(1, 1, 10.0), (2, 1, 950.0), (3, 4, 960.0), (4, 2, 5000.0), (5, 7, -50.0), (6, None, None), (7, 2, -10.0)]
    got = tables.g7({"supplier": spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double")}.get)
    want = {k: k for k, _, _ in rows}
    for _ in rows:
        for a, n, x in rows:
            for b, m, y in rows:
                if (n is not None and n == m) or (x is not None and y is not None and x // 100 == y // 100):
                    want[a] = min(want[a], want[b])
    assert {r.node: r.component for r in got.collect()} == want == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 4}


def test_overlap_of_all_orders(spark):
    lines = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (5, 7), (6, 9), (7, 9), (7, 7)], "l_orderkey long, l_partkey long")
    parts = spark.createDataFrame([(7, 49), (8, 48), (9, 50)], "p_partkey long, p_size int")
    assert tables.j11({"lineitem": lines, "part": parts}.get).first().n == 4


def test_first_lines_go_by_place_in_the_table(spark, tmp_path):
    """Spark reads the larger file first, the table's order is that of its names."""
    schema = "l_orderkey long, l_linenumber int, l_partkey long"
    spark.createDataFrame([(1, 1, 5), (1, 1, 3), (2, 2, 8), (2, 1, 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1, 1, 4), (2, 1, 7)] + [(k, 1, k) for k in range(3, 3000)], schema).coalesce(1).write.parquet(f"{tmp_path}/b")
    got = tables.w1(lambda name: spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b"))
    assert {r.l_orderkey: r.l_partkey for r in got.where("l_orderkey < 3").collect()} == {1: 5, 2: 9}
    assert got.columns == ["l_orderkey", "l_linenumber", "l_partkey"]
