"""The graph read model on small cases: bounded views, grouping, communities, edits of entities."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import plans
from ledgerloom.operators import graph as g
from ledgerloom.operators.rosters import numbered

EDGE = "id string, kind string, source string, target string, asset string, amount long, value long, no_price boolean, unverified boolean, poison boolean"


def nodes_of(edges, flagged=()):
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.lit("address").alias("kind"), F.col("id").isin(list(flagged)).alias("flagged"))


@pytest.fixture(scope="module")
def desk(spark):
    """A trading desk: five vendors paid in two tokens, twelve drips in, one of them from a flagged faucet, a look-alike that moves nothing, an unverified token."""
    rows = [(f"mv:v{i}", "transfer", "addr:desk", f"addr:vendor{i}", "GOLD" if i % 2 else "SILVER", 700 + i, 90 * (i + 1), False, False, False) for i in range(5)]
    rows += [(f"mv:f{i}", "transfer", f"addr:faucet{i}", "addr:desk", "SILVER", 3, 2, False, False, False) for i in range(12)]
    rows += [("mv:p", "transfer", "addr:vend0r1", "addr:desk", "GOLD", 0, None, True, False, True), ("mv:u", "transfer", "addr:spam", "addr:desk", "FREE", 10**9, None, True, True, False)]
    edges = spark.createDataFrame(rows, EDGE)
    return nodes_of(edges, ["addr:faucet7"]), edges


def test_view_sorts_edges_into_buckets(desk):
    v = g.build_view(*desk, "addr:desk", dust_value=10, dust_amount=5, fold_amounts={"GOLD": 702})
    assert {r["id"] for r in v.edges.collect()} == {"mv:v0", "mv:v2", "mv:v3", "mv:v4", "mv:f7"} and v.bounded
    assert {(r["direction"], r["bucket"]): (r["edges"], r["value"]) for r in v.folds.collect()} == {("in", "dust"): (11, 22), ("in", "poison"): (1, None), ("in", "unverified"): (1, None), ("out", "fold:GOLD"): (1, 180)}


def test_view_expands_and_caps(desk):
    v = g.build_view(*desk, "addr:desk", dust_value=10, dust_amount=5, node_cap=400, expand=("dust:addr:desk:in",))
    assert v.nodes.count() == 18 and {r["bucket"] for r in v.folds.collect()} == {"poison", "unverified"}
    v = g.build_view(*desk, "addr:desk", dust_value=10, dust_amount=5, node_cap=3)
    assert v.nodes.count() == 3 and {r["id"] for r in v.edges.collect()} == {"mv:f7", "mv:v4"} and v.folds.agg(F.sum("edges")).first()[0] == 17


def walked(rows, flagged, focus, hops, cap):
    """The rules of a bounded view, edge by edge: dust below value 20 or, without a price, amount 30; a fold below value 60."""
    depth, frontier, kept, folds = {focus: 0}, [focus], set(), {}

    def bucket(e, other):
        _, _, _, _, _, amount, value, _, unverified, poison = e
        if other in flagged:
            return "significant"
        for name, hit in (("unverified", unverified), ("poison", poison), ("dust", value < 20 if value is not None else amount < 30), ("fold", value is not None and value < 60)):
            if hit:
                return name
        return "significant"

    for hop in range(hops):
        reached = []
        for way, end, other in (("in", 3, 2), ("out", 2, 3)):
            incident = [e for e in rows if e[end] in frontier and e[2] != e[3]]
            room = max(0, cap - len(depth))
            rank = lambda e: (frontier.index(e[end]), e[6] is not None, -(e[6] if e[6] is not None else e[5]), e[0])  # noqa: B023, E731
            chosen = sorted((e for e in incident if bucket(e, e[other]) == "significant"), key=rank)[:room]
            for e in chosen:
                kept.add(e[0])
                if e[other] not in depth:
                    depth[e[other]] = hop + 1
                    reached.append(e[other])
            for e in incident:
                if e not in chosen:
                    name = bucket(e, e[other])
                    place = (e[end], way, "dust" if name == "significant" else name)
                    folds[place] = folds.get(place, 0) + 1
        frontier = reached
    return depth, {e[0] for e in rows if e[0] in kept and e[2] in depth and e[3] in depth}, folds


@pytest.mark.parametrize("seed", [1, 2])
def test_two_hops_equal_a_plain_walk(spark, seed):
    """A tight cap over two hops; a plain table of edges and the store give the same view."""
    rng, rows = random.Random(seed), []
    for i in range(400):
        a, b = (f"addr:{int(rng.paretovariate(0.8)) % 40}" for _ in range(2))
        priced = rng.random() < 0.7
        rows.append((f"mv:{i:03d}", "transfer", a, b, "T", rng.randint(0, 200), rng.randint(0, 200) if priced else None, not priced, rng.random() < 0.1, rng.random() < 0.1))
    edges = spark.createDataFrame(rows, EDGE)
    flagged = {f"addr:{i}" for i in range(3, 40, 9)}
    for source in (edges, g.EdgeStore(edges, 8)):
        v = g.build_view(nodes_of(edges, flagged), source, "addr:1", hops=2, node_cap=20, dust_value=20, dust_amount=30, fold_value=60)
        got = {r["id"]: r["depth"] for r in v.nodes.collect()}, {r["id"] for r in v.edges.collect()}, {(r["hub"], r["direction"], r["bucket"]): r["edges"] for r in v.folds.collect()}
        assert got == walked(rows, flagged, "addr:1", 2, 20) and max(got[0].values()) == 2


def test_a_step_reads_the_folders_of_its_nodes(desk):
    step = g.EdgeStore(desk[1], 8).incident(["addr:desk"], "source")
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan and step.count() == 5 and step.columns == desk[1].columns


def test_marks_and_trace_overlay(spark):
    edges = g.build_edges(
        spark.createDataFrame([("transfer", 1, 5, "a", "b", "X", 7, None, 90, "s"), ("transfer", 2, 5, "a", "b", "Y", 7, 3, 101, "s"), ("tx_output", 3, 6, None, "c", "X", 7, None, None, "s")], "subject_type string, id long, tx_id long, src string, dst string, asset string, amount long, value long, seq long, source_name string"),
        spark.createDataFrame([], "id long, tx_id long, address string, asset string, amount long, seq long, source_name string"),
    )
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    marked = g.mark_edges(edges, spark.createDataFrame([(100,)], "settled long"), ids("mv:2"), spark.createDataFrame([("X",), ("Y",)], "asset string"), ids("mv:1"))
    assert {r["id"]: (r["finality"], r["contested"], r["unverified"], r["poison"]) for r in marked.collect()} == {"mv:1": ("final", False, True, True), "mv:2": ("provisional", True, False, False), "out:3": ("provisional", False, False, False)}
    trace = g.trace_overlay(spark.createDataFrame([(3, 4, "c", None, 7)], "source_id long, dest_id long, source string, target string, amount long"), marked)
    assert trace.columns == marked.columns and [(r["id"], r["kind"], r["source"], r["target"], r["amount"], r["contested"]) for r in trace.collect()] == [("trace-3-4", "trace", "addr:c", "external", 7, False)]


def test_parents_in_a_view_by_precedence(spark):
    """An entity, two counterparties of one denomination, and a triangle that has neither."""
    rows = [(f"mv:{i}", "transfer", f"addr:{a}", f"addr:{b}", "T", n, None, True, False, False) for i, (a, b, n) in enumerate([("hub", "e", 5), ("hub", "p", 50), ("q", "hub", 50), ("x", "y", 1), ("y", "z", 2), ("z", "x", 3), ("hub", "x", 9), ("e", "x", 4)])]
    edges = spark.createDataFrame(rows, EDGE)
    view_nodes = spark.createDataFrame([(f"addr:{n}", 1) for n in ("hub", "e", "p", "q", "x", "y", "z")], "id string, depth int")
    entities = spark.createDataFrame([("addr:e", "ent:1"), ("addr:outside", "ent:2"), ("addr:p", None)], "node string, parent string").filter("parent is not null")
    got = {r["node"]: (r["parent"], r["kind"]) for r in g.view_parents(view_nodes, edges, entities, "addr:hub").collect()}
    pool, group = ("dgrp:addr:hub:T:50", "denomination"), ("comm:addr:x", "community")
    assert got == {"addr:e": ("ent:1", "entity"), "addr:p": pool, "addr:q": pool, "addr:x": group, "addr:y": group, "addr:z": group}


def test_view_walks_hops(spark):
    rows = [(f"mv:{i}", "transfer", f"addr:{i}", f"addr:{i + 1}", "ETH", 10, 100, False, False, False) for i in range(5)] + [("t", "trace", "addr:0", "addr:2", None, None, None, True, False, False)]
    edges = spark.createDataFrame(rows, EDGE)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.lit("address").alias("kind"), F.lit(False).alias("flagged"))
    v = g.build_view(nodes, edges, "addr:1", hops=2)
    assert {r["id"]: r["depth"] for r in v.nodes.collect()} == {"addr:1": 0, "addr:0": 1, "addr:2": 1, "addr:3": 2}
    assert {r["id"] for r in v.edges.collect()} == {"mv:0", "mv:1", "mv:2", "t"}


def test_group_parents_in_sequence(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(60)}", f"g{rng.randrange(40):02d}") for _ in range(150)]
    want, taken = {}, set()
    for group in sorted({b for _, b in rows}):
        inside = {a for a, b in rows if b == group} - taken
        if len(inside) >= 2:
            want |= dict.fromkeys(inside, group)
            taken |= inside
    got = g.group_parents(spark.createDataFrame(rows, "node string, group string")).collect()
    assert {r["node"]: r["parent"] for r in got} == want and len(got) == len(want)


def test_grf_22_on_the_tables(spark):
    from ledgerloom.plans.fixtures import Ledger

    sf = "/root/testdata/sf0.001"
    rows = [(r["address"], f"{r['label']}|{int(r['address'][1:]) % 97}") for r in Ledger(spark, sf).attribution.collect()]
    want, taken = {}, set()
    for group in sorted({b for _, b in rows}):
        inside = {a for a, b in rows if b == group} - taken
        if len(inside) >= 2:
            want |= dict.fromkeys(inside, group)
            taken |= inside
    assert {r["node"]: r["parent"] for r in plans.QUERIES["grf_22"](spark, sf).collect()} == want


def test_communities(spark):
    """Two cliques with one edge between them are two communities; a lone pair is one."""
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0"), ("x", "y"), ("z", "z")], "source string, target string")
    got = {r["node"]: r["community"] for r in g.communities(edges).collect()}
    assert got == {f"a{i}": "a0" for i in range(6)} | {f"b{i}": "b0" for i in range(6)} | {"x": "x", "y": "x"}


def test_merges_reject_cycles(spark):
    entities = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, None), (5, None)], "id long, merged_into long")
    merges = spark.createDataFrame([(2, 3), (2, 1), (9, 4), (4, 5), (5, 4), (1, 2)], "into long, from long").withColumnsRenamed({"into": "into", "from": "from"})
    kept, rejected = g.merge_entities(entities, merges)
    assert {r["id"]: r["merged_into"] for r in kept.collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: None}
    assert {(r["into"], r["from"]): r["why"] for r in rejected.collect()} == {(2, 1): "already merged", (1, 2): "already merged", (9, 4): "unknown entity", (4, 5): "cycle", (5, 4): "cycle"}


def test_numbered_within_groups(spark):
    rows = spark.range(1_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1_000).alias("v"))
    got = sorted((r["g"], r["v"], r["place"]) for r in numbered(rows, ["v"], within=["g"]).collect())
    want = []
    for group in range(3):
        values = sorted(r["v"] for r in rows.collect() if r["g"] == group)
        want += [(group, v, i + 1) for i, v in enumerate(values)]
    assert got == want
