"""Golden values and every registered query against its SQL on the smallest tables."""

import hashlib
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import plans
from ledgerloom.functions import scalars as s
from ledgerloom.operators import clustering as c
from ledgerloom.operators import merges as m
from ledgerloom.operators import movements as mv
from ledgerloom.operators import tracing as t
from ledgerloom.operators.components import connected_components
from ledgerloom.plans.fixtures import Ledger

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders lineitem customer supplier part nation region".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    df = plans.QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in plans.SQL:
        assert rows
        return
    found = oracle.execute(plans.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(normal(r[x]) for x in columns) for r in rows) == sorted(tuple(normal(r[names.index(x)]) for x in columns) for r in found.fetchall())


def test_fifo_golden(spark):
    inputs = spark.createDataFrame([(1, 10, 0, 60), (1, 11, 1, 40)], "tx_id long, id long, input_index long, amount long")
    outputs = spark.createDataFrame([(1, 20, 0, 70), (1, 21, 1, 25)], "tx_id long, id long, output_index long, amount long")
    links = t.fifo_apportion(inputs, outputs)
    assert sorted(map(tuple, links.select("source_id", "dest_id", "amount").collect())) == [(10, 20, 60), (11, 20, 10), (11, 21, 25)]
    assert t.conservation(links, inputs, outputs).count() == 0


def test_value_golden(spark):
    df = spark.createDataFrame([(str(10**18), Decimal("2000.5"), str(120000), Decimal(60000)), (str(2**256), Decimal(1), None, None)], "a string, p decimal(18,8), b string, q decimal(18,8)")
    rows = df.select(s.compute_value(F.col("a"), 18, F.col("p")), s.compute_value(F.col("b"), 8, F.col("q")), s.exact_value(F.col("a"), F.lit(18), F.col("p").cast("string"))).collect()
    assert rows[0][0] == "2000.500000000000000000" and rows[0][1] == "72.000000000000000000"
    assert rows[1][0] is None and rows[1][2].startswith("115792089237316195423570985008687907853269984665640564039457.584007913129639936")


@pytest.mark.parametrize("edges,expected", [
    ([], {}),
    ([(1, 2), (2, 3), (5, 4), (4, 4), (9, 9), (None, 7)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 9: 9}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
])
def test_components(spark, edges, expected):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == expected


def test_coinjoin_golden(spark):
    inputs = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "tx_id long, id long")
    outputs = spark.createDataFrame([(1, 5_000_000)] * 5 + [(2, 1_000 + i) for i in range(19)], "tx_id long, amount long")
    assert [r["tx_id"] for r in c.coinjoins(inputs, outputs).collect()] == [1]


def test_merge_cycle(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 5)], "id long, merged_into long")
    assert {r["id"]: r["cyclic"] for r in c.resolve_merges(rows).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_merges_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, None, 5), (4, None, 5)], "seq long, k string, v long")
    once = m.first_rows(rows, ["k", "v"])
    assert sorted(r["seq"] for r in once.collect()) == [1, 3]
    assert sorted(map(tuple, m.first_rows(once.unionByName(once), ["k", "v"]).collect())) == sorted(map(tuple, once.collect()))


def test_rollup_keeps_individual_edges(spark):
    rows = [(1, "a", "b", "X", 10, 5, "final", "s", False), (2, "a", "b", "X", 20, None, "provisional", "t", False), (3, "a", "b", "X", 1, 1, "final", "s", True)]
    df = spark.createDataFrame(rows, "id long, source string, target string, asset string, amount long, value_e4 long, finality string, source_name string, annotated boolean")
    out = {r["count"]: r for r in mv.rollup_parallel(df, F.col("annotated")).collect()}
    assert out[2]["amount"] == 30 and out[2]["finality"] == "provisional" and out[2]["no_price"] == 1 and out[1]["amount"] == 1
    assert sorted(r["id"] for r in mv.rollup_members(df, F.col("annotated")).collect()) == [1, 2]


def union_find(groups):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for group in groups:
        for x in group[1:]:
            a, b = sorted((find(group[0]), find(x)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def members(rows, key, member):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r[member])
    return list(out.values())


def test_clusters_of_all_transactions(spark):
    d = Ledger(spark, DATA)
    want = union_find(members(d.tx_output.select("tx_id", "address").collect(), "tx_id", "address"))
    rows = lambda name: plans.QUERIES[name](spark, DATA).collect()
    assert {r["node"]: r["component"] for r in rows("grf_01")} == want
    assert {r["address"]: r["cluster"] for r in rows("grf_02")} == want
    assert {r["address"]: r["entity_id"] for r in rows("grf_17")} == {k: hashlib.sha256(f"run-1|{v}".encode()).hexdigest() for k, v in want.items()}
    sizes = Counter(want.values())
    assert {r["address"]: (r["cluster"], r["size"]) for r in rows("agg_12")} == {k: (v, sizes[v]) for k, v in want.items()}


def test_change_clusters_of_all_transactions(spark):
    d = Ledger(spark, DATA)
    single = {(r["tx_id"], r["heuristic"]): r["id"] for r in plans.QUERIES["grf_12"](spark, DATA).collect()}
    votes = Counter((tx, i) for (tx, _), i in single.items())
    change = {}
    for (tx, i), n in votes.items():
        if n >= 2:
            change.setdefault(tx, []).append((i, n))
    address = {r["id"]: r["address"] for r in d.tx_output.collect()}
    groups = {tx: [address[x[0][0]]] for tx, x in change.items() if len(x) == 1}
    for r in d.tx_input.collect():
        if r["tx_id"] in groups:
            groups[r["tx_id"]].append(r["address"])
    want = union_find([g for g in groups.values() if len(set(g)) > 1])
    assert {r["address"]: r["cluster"] for r in plans.QUERIES["grf_13"](spark, DATA).collect()} == want


def test_lines_are_shuffled_and_sorted_by_order_once(spark, tmp_path):
    """One shuffle of lines by order, one sort; an order row that is there twice numbers its lines through, as a window over the join does."""
    source = "/root/testdata/sf0.001"
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{source}/orders.parquet")
    orders.unionByName(orders.filter("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1)).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = Ledger(spark, str(tmp_path)).lines.select("l_orderkey", "rn", "cust", "l_linenumber", "brand")
        plan = lines._jdf.queryExecution().executedPlan().toString()
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 2  # lines and orders
    assert plan.count("Sort [l_orderkey") == 2
    wanted = spark.read.parquet(f"{tmp_path}/lineitem.parquet").join(spark.read.parquet(f"{tmp_path}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").count().collect()
    found = {}
    for r in rows:
        found.setdefault(r["l_orderkey"], []).append((r["rn"], r["l_linenumber"]))
    assert {k: len(v) for k, v in found.items()} == {r["l_orderkey"]: r["count"] for r in wanted}
    for numbered in found.values():
        assert [n for n, _ in sorted(numbered)] == list(range(1, len(numbered) + 1))
        assert [line for _, line in sorted(numbered)] == sorted(line for _, line in numbered)
