"""Imports that count what they leave out, bounded pulls, and hubs with more counterparties than places."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import movements as m
from ledgerloom.sources import payloads as p
from ledgerloom.sources.imports import OUTCOMES, write_import

CSV = "tx_hash string, src string, dst string, value_in string, value_out string, status string"
ROWS = [("a", "A", "B", "", "1.5", ""), ("b", "A", "B", "2", "0", ""), ("c", "A", "B", "0", "0", ""), ("d", "A", "B", "7", "", "Error(0)"), ("e", "A", "B", "x", "", ""), ("f", "A", "B", "0.123", "0", ""), ("g", None, None, None, None, None)]


def test_counters_come_from_the_run_that_writes(spark, tmp_path):
    classified = p.classify_explorer_csv(spark.createDataFrame(ROWS, CSV).coalesce(1), 2)
    spark.sparkContext.setJobGroup("import", "import")
    counters = write_import(classified, f"{tmp_path}/out", F.col("tx_hash") == "f")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("import")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = counters.first().asDict()
    assert found == {"rows": 7, "ok": 3, "skipped": 2, "failed": 1, "rejected_utxo": 0, "unsupported": 0, "error": 1, "rounded": 1, "truncation_risk": 1, "partial": True}
    assert len(jobs) == 1
    again = {r["outcome"]: r["count"] for r in classified.groupBy("outcome").count().collect()}
    assert {o: found[o] for o in OUTCOMES if found[o]} == again
    written = {r["tx_hash"]: r["amount"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert written == {"a": "150", "b": "200", "f": "12"}
    assert {r["tx_hash"] for r in p.adapt_explorer_csv(spark.createDataFrame(ROWS, CSV), 2).collect()} == {"a", "b", "f"}


def test_empty_and_strange_imports(spark, tmp_path):
    classified = p.classify_explorer_csv(spark.createDataFrame(ROWS, CSV), 2)
    assert set(write_import(classified.filter("false"), f"{tmp_path}/none").first()) == {0, False}
    for wrong in (F.lit("lost"), F.lit(None).cast("string")):
        with pytest.raises(ValueError, match="outcome"):
            write_import(classified.withColumn("outcome", wrong), f"{tmp_path}/{random.random()}")


def test_bounded_pull(spark):
    rows = [("hot", i % 50, i) for i in range(500)] + [("cold", None, -1), ("cold", 3, -2), (None, 1, -3)] + [("five", 1, i + 1000) for i in range(5)]
    df = spark.createDataFrame(rows, "src string, h long, id long").repartition(6)
    got = sorted((r["src"] or "", r["id"], r["partial"]) for r in m.bounded_pull(df, "src", ["h", "id"], 5).collect())
    want = [("", -3, False), ("cold", -2, False), ("cold", -1, False), *[("five", i + 1000, False) for i in range(5)], *[("hot", i, True) for i in (0, 50, 100, 150, 200)]]
    assert got == sorted(want)
    plan = m.bounded_pull(df, "src", ["h", "id"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_counterparties_of_a_hub(spark):
    rng = random.Random(1)
    rows = [("hub", f"o{rng.randrange(200)}", rng.choice([None, rng.randint(0, 50)]), rng.randint(0, 9)) for _ in range(600)]
    edges = spark.createDataFrame(rows, "source string, target string, value_e4 long, amount long")
    got = {(r["hub"], r["direction"], r["other"]): (r["value_e4"], r["amount"], r["place"], r["folded"]) for r in m.capped_counterparties(edges, 20).collect()}
    sums = {}
    for _, o, v, a in rows:
        s = sums.setdefault(o, [None, 0])
        s[0], s[1] = (s[0] or 0) + v if v is not None else s[0], s[1] + a
    order = sorted(sums, key=lambda o: (sums[o][0] is not None, -(sums[o][0] if sums[o][0] is not None else sums[o][1]), o))
    assert {k[2]: v for k, v in got.items() if k[:2] == ("hub", "out")} == {o: (*sums[o], i + 1 if i < 20 else None, i >= 20) for i, o in enumerate(order)}
    assert sum(k[1] == "in" for k in got) == len(order) and not any(v[3] for k, v in got.items() if k[1] == "in")
