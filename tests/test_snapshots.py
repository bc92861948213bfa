"""Merkle snapshots, transfer merges and clusters that grow batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import clustering as c
from ledgerloom.operators import merkle
from ledgerloom.operators import movements as mv

SCHEMA = "id long, part string, v string"


def tree_of(spark, rows, depth=2, parts=3):
    return merkle.snapshot(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["id", "part"], ["id", "part", "v"], depth)


@pytest.fixture(scope="module")
def base():
    rng = random.Random(3)
    return [(i, rng.choice(["a", "b", None, ""]), rng.choice(["x", "y", None, ""])) for i in range(300)] + [(None, None, None), (7, "twice", "x"), (7, "twice", "x")]


def root(s):
    return s.anchor().first()["digest"]


def test_any_change_moves_the_root(spark, base):
    want = root(tree_of(spark, base))
    assert root(tree_of(spark, base[::-1], parts=1)) == want  # neither order nor layout counts
    i = next(i for i, r in enumerate(base) if r[2] is None)
    others = [base[:-1], [*base, base[5]], [*base[:i], (*base[i][:2], ""), *base[i + 1 :]]]
    assert len({want, *(root(tree_of(spark, o)) for o in others)}) == 4


def test_difference_equals_the_outer_join(spark, base):
    rng = random.Random(8)
    after = [r for r in base if rng.random() > 0.02]
    after = [(r[0], r[1], "z") if rng.random() < 0.02 else r for r in after] + [(900 + i, "n", "x") for i in range(4)]
    a, b = tree_of(spark, base), tree_of(spark, after)
    side = lambda rows: {k: sorted(str(r) for r in rows if r[:2] == k) for k in {r[:2] for r in rows}}
    old, new = side(base), side(after)
    want = {(k, "deleted" if k not in new else "added" if k not in old else "modified") for k in {*old, *new} if old.get(k) != new.get(k)}
    assert {((r["id"], r["part"]), r["change"]) for r in merkle.changes(a, b).collect()} == want and len(want) > 4
    leaves = merkle.differing(a, b).count()
    assert 0 < leaves <= len(want)
    assert merkle.changes(a, a).count() == 0 and merkle.differing(a, a).count() == 0


def test_difference_reads_the_differing_folders_only(spark, base):
    a, b = tree_of(spark, base), tree_of(spark, [*base[:-3], (None, None, "changed"), *base[-2:]])
    found = merkle.changes(a, b)
    assert [tuple(r) for r in found.collect()] == [(None, None, "modified")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "copies:bigint" in line]
    assert read and all("StartsWith(top" in line for line in read), plan


def test_empty_snapshot(spark, base):
    empty = merkle.snapshot(spark.createDataFrame([], SCHEMA), ["id"], ["v"], 2)
    assert empty.anchor().first()["rows"] == 0 and len(root(empty)) == 64
    full = merkle.snapshot(spark.createDataFrame(base, SCHEMA), ["id"], ["v"], 2)
    assert {r["change"] for r in merkle.changes(empty, full).collect()} == {"added"} and {r["change"] for r in merkle.changes(full, empty).collect()} == {"deleted"}
    with pytest.raises(ValueError, match="depth"):
        merkle.differing(empty, merkle.snapshot(spark.createDataFrame(base, SCHEMA), ["id"], ["v"], 3))


def test_equal_movements_stay_two(spark):
    """Two equal movements of one transaction, reported by two sources, one of which knows a third."""
    rows = [("s1", 1, 5), ("s1", 2, 5), ("s2", 11, 5), ("s2", 12, 5), ("s2", 13, 5), ("s1", 3, None)]
    df = spark.createDataFrame([(s, i, "tx", v) for s, i, v in rows], "source string, id long, tx string, amount long")
    got = sorted((r["amount"] or 0, r["occurrence"], r["id"], r["writers"]) for r in mv.merge_transfers(df, ["tx", "amount"]).collect())
    assert got == [(0, 0, 3, 1), (5, 0, 1, 2), (5, 1, 2, 2), (5, 2, 13, 1)]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["entity_id"], set()).add(r["address"])
    return sorted(map(sorted, out.values()))


def test_clusters_in_batches_equal_one_run(spark):
    rng = random.Random(6)
    rows = [(tx, f"a{rng.randrange(60)}") for tx in range(40) for _ in range(rng.randint(1, 3))]
    schema = "tx_id long, address string"
    all_, halves = spark.createDataFrame(rows, schema), [spark.createDataFrame([r for r in rows if r[0] % 2 == h], schema) for h in (0, 1)]
    none, no_mix = spark.createDataFrame([], "address string, entity_id string"), spark.createDataFrame([], "tx_id long")
    whole, merges = c.cospend_batch(none, all_, no_mix, "one")
    assert merges.count() == 0
    first, _ = c.cospend_batch(none, halves[0], no_mix, "run-1")
    second, merges = c.cospend_batch(first, halves[1], no_mix, "run-2")
    now = c.current_members(first.unionByName(second), merges)
    assert groups(now.collect()) == groups(whole.collect())
    old = {r["address"]: r["entity_id"] for r in first.collect()}
    final = {r["address"]: r["entity_id"] for r in now.collect()}
    for members in groups(now.collect()):
        known = {old[m] for m in members if m in old}
        assert {final[m] for m in members} == ({min(known)} if known else {final[members[0]]})
    bridged = {(e, min(k)) for ms in groups(now.collect()) for k in [{old[m] for m in ms if m in old}] for e in k if e != min(k)}
    assert {tuple(r) for r in merges.collect()} == bridged and bridged
    for batch in (halves[1], all_):  # again: nothing changes
        more, again = c.cospend_batch(now, batch, no_mix, "run-3")
        assert more.count() == 0 and again.count() == 0


def test_one_address_of_two_entities(spark):
    members = spark.createDataFrame([("x", "e2"), ("x", "e1"), ("y", "e3")], "address string, entity_id string")
    new, merges = c.extend_clusters(members, spark.createDataFrame([("y", "z"), ("q", None)], "a string, b string"), "r")
    assert [tuple(r) for r in new.collect()] == [("z", "e3")] and [tuple(r) for r in merges.collect()] == [("e2", "e1")]


def test_flags_of_mixes(spark):
    inputs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "tx_id long, address string")
    new, _ = c.cospend_batch(inputs.select("address", F.lit("").alias("entity_id")).filter("false"), inputs, inputs.filter("tx_id = 2").select("tx_id"), "r")
    assert {r["address"]: (r["flagged"], r["confidence"]) for r in new.collect()} == {"a": (False, 0.9), "b": (False, 0.9), "c": (True, 0.5), "d": (True, 0.5)}
