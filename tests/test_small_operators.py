"""Activity timeline, focus lookup, orderings and delistings on small cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import to_base_units
from ledgerloom.operators import clustering as c
from ledgerloom.operators import graph as g
from ledgerloom.operators import movements as m
from ledgerloom.operators import rosters as r
from ledgerloom.operators.activity import activity_timeline


def test_timeline(spark):
    rows = lambda schema, *data: spark.createDataFrame(list(data), schema)
    tables = {
        "source_query": rows("id string, connector string, capability string, endpoint string, requested_at string, status string", ("q1", "feed", "prices", "x" * 90, "2024-02", "ok"), ("q2", "feed", None, "  ", "2024-01", "error"), ("q3", "feed", "p", None, None, None)),
        "trace": rows("id string, name string, created_at string", ("t1", "kept", "2024-02"), ("t2", "gone", "2024-02")),
        "trace_retraction": rows("trace_id string", ("t2",), (None,)),
        "tag": rows("id string, target_type string, label string, created_at string", ("g", "entity", "hot", "2024-02")),
        "trace_btc_link_retraction": rows("id long, created_at string", (9, "2024-03"), (10, "2024-03")),
    }
    got = [tuple(x) for x in activity_timeline(tables).collect()]
    assert got == [
        (None, "fetch", "Fetched feed · p", "source_query", "q3", None),
        ("2024-01", "fetch", "Fetched feed · None · error", "source_query", "q2", None),
        ("2024-02", "fetch", "Fetched feed · prices", "source_query", "q1", "x" * 79 + "…"),
        ("2024-02", "tag", "Tag 'hot' added to entity", "tag", "g", None),
        ("2024-02", "trace", "Trace created: kept", "trace", "t1", None),
        ("2024-03", "trace_edit", "Trace BTC link retracted", "trace_btc_link_retraction", "10", None),
        ("2024-03", "trace_edit", "Trace BTC link retracted", "trace_btc_link_retraction", "9", None),
    ]
    with pytest.raises(ValueError, match="asset"):
        activity_timeline({"asset": tables["tag"]})


def test_focus(spark):
    nodes = spark.createDataFrame([("addr:Abc", "Abc"), ("addr:abcd", "abcd"), ("addr:zz", "zz"), ("tx:1", None)], "id string, address string")
    found = {x["text"]: (x["node"], x["how"]) for x in g.find_focus(nodes, ["tx:1", " ABC", "ABCD ", "z", "q", " "], "addr:zz").collect()}
    assert found == {"tx:1": ("tx:1", "id"), " ABC": ("addr:Abc", "exact"), "ABCD ": ("addr:abcd", "exact"), "z": ("addr:zz", "prefix"), "q": ("addr:zz", "default"), " ": ("addr:zz", "default")}
    assert {x["node"] for x in g.find_focus(nodes.filter("false"), ["a"], None).collect()} == {None}


def test_neighbours_in_order(spark):
    rows = [("transfer", "h", "a", "X", 5, 10, 3), ("transfer", "a", "h", "Y", 9, None, None), ("transfer", "h", "b", "X", 7, 4, 1), ("trace", "h", "c", "X", 1, 1, 1), ("tx_output", "d", "h", "X", 0, None, None), ("transfer", "h", "h", "X", 1, 1, 1), ("transfer", "h", "e", "Y", 9, 4, 2)]
    edges = spark.createDataFrame(rows, "kind string, source string, target string, asset string, amount long, value long, seq long")
    order = lambda mode: {x["node"]: (x["asset"], x["key"], x["place"], x["tray"]) for x in g.neighbour_order(edges, "h", mode).collect()}
    assert order("value") == {"b": ("", 4, 1, False), "e": ("", 4, 2, False), "a": ("", 10, 3, False), "d": ("", None, None, True)}
    assert order("sequence") == {"b": ("", 1, 1, False), "e": ("", 2, 2, False), "a": ("", 3, 3, False), "d": ("", None, None, True)}
    assert order("native") == {"b": ("X", 7, 1, False), "a": ("Y", 9, 2, False), "e": ("Y", 9, 3, False), "d": ("", None, None, True)}


def test_top_counterparties(spark):
    rows = [(1, "a", "me"), (2, "me", "a"), (3, "b", "me"), (4, "c", "me"), (5, None, "me"), (6, "x", "y"), (7, "me", None)]
    df = spark.createDataFrame(rows, "id long, src string, dst string")
    assert {x["id"] for x in m.top_counterparties(df, "me", 2).collect()} == {1, 2, 3, 5, 7}


def test_delisted(spark):
    known = spark.createDataFrame([("e", "1"), ("e", "1"), ("e", "2"), ("b", "2")], "chain string, address string")
    now = spark.createDataFrame([("e", "2")], "chain string, address string")
    read = spark.createDataFrame([("2024-05-01",), (None,)], "d string").select(F.col("d").cast("date").alias("published"))
    on = lambda day, editions=read: sorted(tuple(x) for x in r.delisted(known, now, editions, F.lit(day).cast("date")).collect())
    assert on("2024-05-01") == on(None) == on("2023-01-01", read.filter("false")) == [("b", "2"), ("e", "1")] and on("2024-04-30") == []


def test_hub_reveals_its_first(spark):
    edges = spark.createDataFrame([("h", f"o{i:02d}", i % 7) for i in range(60)], "target string, source string, amount long")
    got = {x["other"] for x in r.revealed(edges, 5).collect() if x["revealed"]}
    assert got == set(sorted((f"o{i:02d}" for i in range(60)), key=lambda o: (-(int(o[1:]) % 7), o))[:5]) and r.revealed(edges, 5).count() == 60


def test_airdrop_cluster_of_any_size(spark):
    """1,200 recipients of one airdrop that send on to one aggregator are one cluster."""
    n = F.col("id").cast("string")
    forwards = spark.range(1200).select(F.lit("a").alias("source"), F.lit("E").alias("asset"), F.lit(1).alias("amount"), F.concat(F.lit("c"), n).alias("recipient"), F.lit("g").alias("aggregator"))
    found = c.airdrop_clusters(forwards)
    assert found.count() == 1201 and [tuple(r) for r in found.select("cluster", "size").distinct().collect()] == [("c0", 1201)]
    assert c.sized(found.select(F.col("address").alias("node"), F.col("cluster").alias("component")), 1200).isEmpty()


def test_base_units_are_computed_from_one_clean_text(spark):
    """A filter on the amounts does not multiply their expression: the plan stays small."""
    df = spark.createDataFrame([("1,234.50",), ("0.0005",), (" 7 ",), ("x",), (None,), ("-0.10",)], "v string")
    found = df.select("v", to_base_units(F.col("v"), F.lit(3)).alias("u"))
    assert {r["v"]: r["u"] and tuple(r["u"]) for r in found.collect()} == {"1,234.50": ("1234500", False, True), "0.0005": ("0", True, False), " 7 ": ("7000", False, False), "x": None, None: None, "-0.10": ("-100", False, True)}
    assert found.filter("u.amount <> '0'")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 8
