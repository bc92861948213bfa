"""Exact amounts, scans that no key has to fit a task for, FIFO by sweep and taint by intervals."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import exact as x
from ledgerloom.operators import movements as m
from ledgerloom.operators import tracing as t
from ledgerloom.operators.scans import exclusive_scan


def test_numbers_of_any_size(spark):
    rng, rows = random.Random(2), []
    for i in range(120):
        big = lambda: rng.randrange(-(10 ** rng.randint(1, 88)), 10 ** rng.randint(1, 88))
        a, b, n = big(), big(), rng.randrange(10 ** rng.randint(1, 18))
        rows.append((i, str(a), str(b), n if abs(a * n) < 10**89 else 1, i % 7))
    df = spark.createDataFrame(rows, "i int, a string, b string, n long, g int")
    a, b = x.parse(F.col("a")), x.parse(F.col("b"))
    found = df.select("a", "b", "n", *(x.text(c).alias(name) for name, c in {"same": a, "sum": x.plus(a, b), "rest": x.minus(a, b), "product": x.times(a, F.col("n"))}.items()), (a < b).alias("less")).collect()
    for r in found:
        p, q = int(r["a"]), int(r["b"])
        assert [r["same"], r["sum"], r["rest"], r["product"]] == [str(v) for v in (p, p + q, p - q, p * r["n"])] and r["less"] == (p < q)
    for r in df.groupBy("g").agg(x.sum_of(df, "a").alias("s"), x.text(F.max(a)).alias("most")).collect():
        own = [int(v[1]) for v in rows if v[4] == r["g"]]
        assert int(r["s"]) == sum(own) and int(r["most"]) == max(own)


def test_texts_that_are_no_numbers(spark):
    given = ["12a", None, "1" * 91, "  +007 ", "-0", "1.5", "", "-" + "9" * 90]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r["n"] for r in df.select(x.text(x.parse(F.col("v"))).alias("n")).collect()] == [None, None, None, "7", "0", None, None, "-" + "9" * 90]
    words = spark.createDataFrame([("0x" + "ff" * 32,), ("",), ("0x1",), ("0xzz",), (None,)], "w string")
    assert [r["n"] for r in words.select(x.text(x.from_hex(F.col("w"))).alias("n")).collect()] == [str(2**256 - 1), "0", "1", None, None]
    assert df.filter("false").agg(x.sum_of(df, "v").alias("s")).first()["s"] is None


def test_amounts_stay_on_the_jvm(spark):
    df = spark.createDataFrame([("1", "a", "5")], "id string, k string, amount string")
    plan = m.running(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clustering_keeps_large_amounts(spark):
    rows = [(1, "a", "b", "E", str(10**19), 1), (2, "a", "b", "E", str(2**256), 2), (3, "a", None, "E", "1", 3), (4, "a", "b", "E", "x", 4), (5, "a", "b", "E", None, 5)]
    df = spark.createDataFrame(rows, "id long, src string, dst string, asset string, amount string, block_height long")
    assert {r["id"]: r["amount"] for r in m.clustering_transfers(df).collect()} == {1: str(10**19), 2: str(2**256)}


def test_scan_over_partitions(spark):
    """One key holds a third of the rows; null keys are a key; what precedes a row crosses partitions."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", None, *"abcdef"]), i, rng.randint(-5, 9), rng.choice([None, f"v{i}"])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, n long, v string").repartition(7)
    got = {(r["k"], r["i"]): (r["s"], r["l"]) for r in exclusive_scan(df, ["k"], ["i"], {"n": "s"}, {"v": "l"}).collect()}
    assert len(got) == 900
    for k in {r[0] for r in rows}:
        total, last = 0, None
        for _, i, n, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            assert got[k, i] == (total, last)
            total, last = total + n, v if v is not None else last


def _fifo(inputs, outputs):
    out, i, j = [], 0, 0
    a, b = [list(v) for v in inputs], [list(v) for v in outputs]
    while i < len(a) and j < len(b):
        n = min(a[i][1], b[j][1])
        if n:
            out.append((a[i][0], b[j][0], n))
        a[i][1] -= n
        b[j][1] -= n
        i, j = i + (a[i][1] == 0), j + (j < len(b) and b[j][1] == 0)
    return sorted(out)


def test_fifo_of_a_large_transaction(spark):
    """20,000 inputs and outputs in one transaction beside small ones, zero amounts among them: links are as many as cuts."""
    rng = random.Random(4)
    sides = {tx: ([rng.choice([0, rng.randint(1, 10**9)]) for _ in range(n)], [rng.choice([0, rng.randint(1, 10**9)]) for _ in range(n)]) for tx, n in ((1, 10_000), (2, 3), (3, 1))}
    rows = lambda side: [(tx, tx * 10**6 + side * 10**5 + i, i, amount) for tx, both in sides.items() for i, amount in enumerate(both[side])]
    inputs = spark.createDataFrame(rows(0), "tx_id long, id long, input_index long, amount long").repartition(5)
    outputs = spark.createDataFrame(rows(1), "tx_id long, id long, output_index long, amount long")
    want = sorted(link for tx in sides for link in _fifo([r[1::2] for r in rows(0) if r[0] == tx], [r[1::2] for r in rows(1) if r[0] == tx]))
    got = t.fifo_apportion(inputs, outputs)
    assert sorted(map(tuple, got.select("source_id", "dest_id", "amount").collect())) == want
    assert got.count() <= inputs.count() + outputs.count()
    scale = lambda df: df.withColumn("amount", F.when(F.col("amount") == 0, "0").otherwise(F.concat(F.col("amount").cast("string"), F.lit("0" * 40))))
    exact = t.fifo_apportion(scale(inputs), scale(outputs))
    assert sorted((r["source_id"], r["dest_id"], int(r["amount"]) // 10**40) for r in exact.collect()) == want
    assert t.fifo_apportion(inputs.filter("false"), outputs).count() == 0


def test_taint_follows_units(spark):
    """Outputs of 60 and 40 become 70 and 25 with a fee of 5; the 70 becomes 50 and 20; the 25 stays."""
    inputs = [(1, 10, 0, 60), (1, 11, 1, 40), (2, 20, 0, 70)]
    outputs = [(0, 10, 0, 60), (0, 11, 1, 40), (1, 20, 0, 70), (1, 21, 1, 25), (2, 30, 0, 50), (2, 31, 1, 20)]
    i = spark.createDataFrame(inputs, "tx_id long, id long, input_index long, amount long")
    o = spark.createDataFrame(outputs, "tx_id long, id long, output_index long, amount long")
    start = spark.createDataFrame([(11, 40)], "output_id long, amount long")
    found = t.taint(t.fifo_intervals(i, o), start, 3)
    assert sorted(map(tuple, found.collect())) == [(11, 0, 40, 0), (20, 60, 70, 1), (21, 0, 25, 1), (31, 10, 20, 2)]
    balance = {r["hop"]: (r["units"], r["moved"], r["fee"], r["resting"]) for r in t.taint_balance(found, i.withColumnRenamed("id", "prev_output_id")).collect()}
    assert balance == {0: (40, 35, 5, 0), 1: (35, 10, 0, 25), 2: (10, 0, None, 10)}
    assert all(u == m + (f or 0) + r for u, m, f, r in balance.values())


def test_scan_shuffles_rows_once(spark):
    """What crosses borders between partitions is broadcast, whatever its estimated size; the rows are not shuffled for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select((F.col("id") % 3).alias("k"), "id")
        found = exclusive_scan(rows, ["k"], ["id"], {"id": "s"})
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["s"] for r in found.collect()} == {i: sum(range(i % 3, i, 3)) for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_totals_of_amounts_in_text_are_plain_sums(spark):
    """A text was read for every limb and a product written and read again; the totals of an address are those of amounts in text and of exact numbers alike."""
    rng = random.Random(8)
    texts = ["12a", None, "1" * 91, "  +007 ", "-0", "1.5", "", "-" + "9" * 90, *(str(rng.randrange(-(10 ** rng.randint(1, 70)), 10 ** rng.randint(1, 70))) for _ in range(60))]
    rows = [(f"a{i % 5}" if i % 9 else None, f"b{i % 4}", "E", v, rng.choice([None, -rng.randrange(10**18), rng.randrange(10**18), 7])) for i, v in enumerate(texts)]
    df = spark.createDataFrame(rows, "src string, dst string, asset string, amount string, f long")
    whole = lambda v: int(v) if v is not None and v.strip().lstrip("+-").isdigit() and len(v) <= 91 and v != "1" * 91 else None
    read = x.numbers(df.withColumn("given", F.col("amount")), "amount")
    product = x.multiplied(read.filter("abs(f) = 7 or given <> '-" + "9" * 90 + "'"), "value", "amount", "f")
    assert "decimal" not in product._jdf.queryExecution().optimizedPlan().toString()
    for r in product.select("given", "f", x.text(F.col("amount")).alias("n"), x.text(F.col("value")).alias("v")).collect():
        n = whole(r["given"])
        assert (r["n"], r["v"]) == (None if n is None else str(n), None if n is None or r["f"] is None else str(n * r["f"]))
    df, read, rows = df.filter("amount is null or length(amount) < 80"), read.filter("given is null or length(given) < 80"), [r for r in rows if len(r[3] or "") < 80]
    inputs = spark.createDataFrame([("b1", "5"), ("b9", "0")], "address string, amount string")
    totals = m.address_totals(df.withColumn("value", F.col("amount")), inputs, F.lit(True))
    numbers = m.address_totals(read.withColumn("value", F.col("amount")), x.numbers(inputs, "amount"), F.lit(True))
    got = {r["address"]: tuple(r)[1:] for r in totals.collect()}
    assert got == {r["address"]: tuple(r)[1:] for r in numbers.collect()} and got["b9"] == (None,) * 4 and got["b1"][3] == "5"
    for who, places in (("dst", (0, 2)), ("src", (1, 3))):
        for address in {r[who == "dst"] for r in rows} - {None}:
            want = sum(whole(r[3]) or 0 for r in rows if r[who == "dst"] == address)
            assert int(got[address][places[0]] or 0) == want and (address == "b1" or int(got[address][places[1]] or 0) == want)
