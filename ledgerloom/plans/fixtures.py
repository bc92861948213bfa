"""The given tables projected onto the ledger model, as DataFrames (Ledger) and as SQL for the oracle (SQL).

Orders are transactions: even keys on an account chain, odd keys on a UTXO chain. Lines of account orders are transfers,
lines of UTXO orders are outputs, and each UTXO order spends the outputs of its customer's previous one. Parts'
brands are assets, customers and suppliers addresses, events the log of source queries, claims and approvals.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SQL = """WITH RECURSIVE ln AS (
  SELECT l.*, o.o_custkey AS cust, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, p.p_brand AS brand,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS rn
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey),
tx AS (
  SELECT o_orderkey AS tx_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ethereum' ELSE 'bitcoin' END AS chain,
         CASE WHEN o_orderkey % 37 <> 0 THEN datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 10 + o_orderkey % 10 END AS block_height,
         CAST(epoch(o_orderdate) AS BIGINT) AS block_ts, CASE WHEN o_orderkey % 41 = 0 THEN 'failed' ELSE 'success' END AS status, o_custkey AS cust
  FROM orders),
pay AS (
  SELECT l_orderkey * 100 + rn AS id, tx_id, chain, 'c' || ln.cust AS src, 's' || l_suppkey AS dst, brand AS asset, cents AS amount, block_height, block_ts,
         rn, ln.cust AS cust, l_suppkey AS supp, l_returnflag AS flag, l_linenumber AS line
  FROM ln JOIN tx ON tx_id = l_orderkey WHERE chain = 'ethereum' AND status = 'success'),
transfer AS (
  SELECT id, tx_id, chain, src, dst, asset, amount, block_height, block_ts, 'payment' AS kind FROM pay
  UNION ALL SELECT id + 50, tx_id, chain, dst, 's' || (supp - supp % 10), asset, amount - line % 2, block_height + 5, block_ts, 'forward'
    FROM pay WHERE flag = 'R' AND tx_id % 100 = 0 AND supp % 10 <> 0
  UNION ALL SELECT tx_id * 100 + 90, tx_id, chain, 'z' || cust, dst, asset, CAST(0 AS BIGINT), block_height + 1, block_ts, 'lookalike'
    FROM pay WHERE rn = 1 AND tx_id % 200 = 2),
tx_output AS (
  SELECT l_orderkey * 100 + rn AS id, tx_id, rn - 1 AS output_index, '1P' || l_partkey AS address, cents AS amount, block_height, ln.cust AS cust
  FROM ln JOIN tx ON tx_id = l_orderkey WHERE chain = 'bitcoin'),
spend AS (SELECT tx_id AS prev_tx, lead(tx_id) OVER (PARTITION BY cust ORDER BY block_ts, tx_id) AS tx_id FROM tx WHERE chain = 'bitcoin'),
tx_input AS (
  SELECT spend.tx_id * 1000 + output_index AS id, spend.tx_id AS tx_id, o.id AS prev_output_id, output_index AS input_index, address, amount
  FROM spend JOIN tx_output o ON o.tx_id = prev_tx WHERE spend.tx_id IS NOT NULL),
asset AS (SELECT DISTINCT p_brand AS asset, CAST(substr(p_brand, 7) AS BIGINT) AS n, p_brand = 'Brand#1' AS native, CAST(substr(p_brand, 7) AS BIGINT) % 3 <> 0 AS listed FROM part),
traded AS (SELECT DISTINCT brand AS asset, block_ts FROM ln JOIN tx ON tx_id = l_orderkey),
price AS (SELECT asset, block_ts AS price_ts, 100 + 7 * n + (block_ts // 86400 - 9131) % 13 AS price_cents FROM traded JOIN asset USING (asset) WHERE listed),
exchange AS (SELECT 's' || s_suppkey AS address FROM supplier WHERE s_suppkey % 10 = 0),
movement AS (
  SELECT 'transfer' AS subject_type, id, tx_id, chain, src, dst, asset, amount FROM transfer
  UNION ALL SELECT 'tx_output', id, tx_id, 'bitcoin', CAST(NULL AS VARCHAR), address, 'BTC', amount FROM tx_output),
attribution AS (
  SELECT 'c' || c_custkey AS address, c_mktsegment AS label, 'segment' AS source, CASE WHEN c_custkey % 50 = 0 THEN 'exchange' ELSE 'business' END AS category FROM customer
  UNION ALL SELECT 'c' || c_custkey, r_name, 'region', 'place' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(epoch_us(ts) AS BIGINT) AS us FROM events),
claim AS (
  SELECT event_id AS id, 'c' || user_id AS subject, event_type AS source, 'label' || k % 5 AS label, CASE WHEN k % 7 <> 0 THEN 'cat' || k % 3 END AS category, us AS retrieved_at
  FROM ev WHERE event_type IN ('click', 'view')),
approval AS (SELECT event_id AS id, 'c' || user_id AS owner, 'c' || (user_id + k % 12) AS spender, us AS retrieved_at FROM ev WHERE event_type = 'purchase'),
source_query AS (
  SELECT event_id AS id, event_type AS connector, 'cap' || event_id % 4 AS capability, props AS params, us AS requested_at, CASE WHEN event_id % 10 = 0 THEN 'partial' ELSE 'ok' END AS status FROM ev),
risk AS (
  SELECT 'c' || doc_id AS address, 'sanctioned' AS category, 'toxicity' AS source FROM labels WHERE toxic = 1
  UNION ALL SELECT 'c' || doc_id, 'low-quality', 'quality' FROM labels WHERE quality = 0),
valued AS (
  SELECT t.id, t.tx_id, t.src, t.dst, t.asset, t.amount, t.kind, t.block_height, amount * price_cents AS value_e4
  FROM transfer t LEFT JOIN price p ON p.asset = t.asset AND p.price_ts = t.block_ts),
edge AS (
  SELECT id, src AS source, dst AS target, asset, amount, value_e4, CASE WHEN block_height IS NULL OR block_height > (SELECT max(block_height) FROM tx) - 64 THEN 'provisional' ELSE 'final' END AS finality,
         CASE WHEN id % 5 = 0 THEN 'etherscan' ELSE 'arkham' END AS source_name, id % 97 = 0 AS annotated, kind
  FROM valued)
"""

#: Amounts as sources give them: text of 24 to 32 digits, every digit used, for the row of an id.
WEI_SQL = "CAST({amount} AS VARCHAR) || lpad(CAST({id} * 999983 % 1000000000000000 AS VARCHAR), 23, '0')"


class Ledger:
    """The same tables as DataFrames, read lazily from sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Lines numbered within their order; one shuffle and one sort by order serve the numbers and the joins by order. Of an order key that is there several times each row has numbers of its own."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]
        again = W.partitionBy("l_orderkey")
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
        orders = orders.withColumns({"__nth": F.row_number().over(again.orderBy("cust")), "__rows": F.count(F.lit(1)).over(again)})
        return (
            self.read("lineitem").join(self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
            .withColumn("rn", F.row_number().over(again.orderBy(*order)).cast("long")).join(orders, "l_orderkey")
            .withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
            .withColumn("rn", (F.col("rn") - 1) * F.col("__rows") + F.col("__nth")).drop("__nth", "__rows")
        )

    @cached_property
    def tx(self) -> DataFrame:
        key = F.col("o_orderkey")
        days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
        return self.read("orders").select(
            key.alias("tx_id"), F.when(key % 2 == 0, "ethereum").otherwise("bitcoin").alias("chain"), F.when(key % 37 != 0, days * 10 + key % 10).alias("block_height"),
            F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("block_ts"), F.when(key % 41 == 0, "failed").otherwise("success").alias("status"), F.col("o_custkey").alias("cust"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        tx = self.tx.filter("chain = 'ethereum' and status = 'success'").drop("cust")
        return self.lines.join(tx, F.col("tx_id") == F.col("l_orderkey")).select(
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), "tx_id", "chain", _name("c", "cust").alias("src"), _name("s", "l_suppkey").alias("dst"), F.col("brand").alias("asset"),
            F.col("cents").alias("amount"), "block_height", "block_ts", "rn", "cust", F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"),
        )

    @cached_property
    def transfer(self) -> DataFrame:
        pay = self.payments
        forward = pay.filter("flag = 'R' and tx_id % 100 = 0 and supp % 10 <> 0").select(
            (F.col("id") + 50).alias("id"), "tx_id", "chain", F.col("dst").alias("src"), F.concat(F.lit("s"), F.col("supp") - F.col("supp") % 10).alias("dst"), "asset",
            (F.col("amount") - F.col("line") % 2).alias("amount"), (F.col("block_height") + 5).alias("block_height"), "block_ts", F.lit("forward").alias("kind"),
        )
        alike = pay.filter("rn = 1 and tx_id % 200 = 2").select(
            (F.col("tx_id") * 100 + 90).alias("id"), "tx_id", "chain", _name("z", "cust").alias("src"), "dst", "asset", F.lit(0).cast("long").alias("amount"),
            (F.col("block_height") + 1).alias("block_height"), "block_ts", F.lit("lookalike").alias("kind"),
        )
        own = pay.select("id", "tx_id", "chain", "src", "dst", "asset", "amount", "block_height", "block_ts", F.lit("payment").alias("kind"))
        return own.unionByName(forward).unionByName(alike)

    @cached_property
    def tx_output(self) -> DataFrame:
        tx = self.tx.filter("chain = 'bitcoin'").drop("cust")
        return self.lines.join(tx, F.col("tx_id") == F.col("l_orderkey")).select(
            (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), "tx_id", (F.col("rn") - 1).alias("output_index"), _name("1P", "l_partkey").alias("address"), F.col("cents").alias("amount"), "block_height", "cust"
        )

    @cached_property
    def tx_input(self) -> DataFrame:
        follow = F.lead("tx_id").over(W.partitionBy("cust").orderBy("block_ts", "tx_id"))
        spend = self.tx.filter("chain = 'bitcoin'").select(F.col("tx_id").alias("prev_tx"), follow.alias("spender")).filter("spender is not null")
        return self.tx_output.join(spend, F.col("tx_id") == F.col("prev_tx")).select(
            (F.col("spender") * 1000 + F.col("output_index")).alias("id"), F.col("spender").alias("tx_id"), F.col("id").alias("prev_output_id"), F.col("output_index").alias("input_index"), "address", "amount"
        )

    @cached_property
    def asset(self) -> DataFrame:
        n = F.substring("p_brand", 7, 10).cast("long")
        return self.read("part").select(F.col("p_brand").alias("asset"), n.alias("n"), (F.col("p_brand") == "Brand#1").alias("native"), (n % 3 != 0).alias("listed")).distinct()

    @cached_property
    def price(self) -> DataFrame:
        """A feed: one row per listed asset and time at which it moved."""
        traded = self.lines.join(self.tx.select("tx_id", "block_ts"), F.col("tx_id") == F.col("l_orderkey")).select(F.col("brand").alias("asset"), "block_ts").distinct()
        return traded.join(self.asset.filter("listed"), "asset").select(
            "asset", F.col("block_ts").alias("price_ts"), (100 + 7 * F.col("n") + (F.expr("block_ts div 86400") - 9131) % 13).alias("price_cents")
        )

    @cached_property
    def exchange(self) -> DataFrame:
        return self.read("supplier").filter("s_suppkey % 10 = 0").select(_name("s", "s_suppkey").alias("address"))

    @cached_property
    def attribution(self) -> DataFrame:
        c, key = self.read("customer"), F.col("c_custkey")
        region = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
        return c.select(_name("c", "c_custkey").alias("address"), F.col("c_mktsegment").alias("label"), F.lit("segment").alias("source"), F.when(key % 50 == 0, "exchange").otherwise("business").alias("category")).unionByName(
            c.join(region, "c_nationkey").select(_name("c", "c_custkey").alias("address"), F.col("r_name").alias("label"), F.lit("region").alias("source"), F.lit("place").alias("category"))
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))

    @cached_property
    def claim(self) -> DataFrame:
        k = F.col("k")
        return self.events.filter(F.col("event_type").isin("click", "view")).select(
            F.col("event_id").alias("id"), _name("c", "user_id").alias("subject"), F.col("event_type").alias("source"), F.concat(F.lit("label"), k % 5).alias("label"),
            F.when(k % 7 != 0, F.concat(F.lit("cat"), k % 3)).alias("category"), F.col("us").alias("retrieved_at"),
        )

    @cached_property
    def approval(self) -> DataFrame:
        spender = F.concat(F.lit("c"), (F.col("user_id") + F.col("k") % 12).cast("string"))
        return self.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), _name("c", "user_id").alias("owner"), spender.alias("spender"), F.col("us").alias("retrieved_at"))

    @cached_property
    def source_query(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            e.alias("id"), F.col("event_type").alias("connector"), F.concat(F.lit("cap"), e % 4).alias("capability"), F.col("props").alias("params"), F.col("us").alias("requested_at"),
            F.when(e % 10 == 0, "partial").otherwise("ok").alias("status"),
        )

    @cached_property
    def risk(self) -> DataFrame:
        labels = self.read("labels")
        row = lambda condition, category, source: labels.filter(condition).select(_name("c", "doc_id").alias("address"), F.lit(category).alias("category"), F.lit(source).alias("source"))
        return row("toxic = 1", "sanctioned", "toxicity").unionByName(row("quality = 0", "low-quality", "quality"))

    @cached_property
    def valued(self) -> DataFrame:
        """Transfers with their value in ten-thousandths of a dollar, null where the feed has no price."""
        price = self.price.withColumnRenamed("price_ts", "block_ts")
        return self.transfer.join(price, ["asset", "block_ts"], "left").select("id", "tx_id", "src", "dst", "asset", "amount", "kind", "block_height", (F.col("amount") * F.col("price_cents")).alias("value_e4"))

    @cached_property
    def edge(self) -> DataFrame:
        tip = self.tx.agg((F.max("block_height") - 64).alias("settled"))
        return self.valued.join(F.broadcast(tip)).select(
            "id", F.col("src").alias("source"), F.col("dst").alias("target"), "asset", "amount", "value_e4",
            F.when(F.col("block_height").isNull() | (F.col("block_height") > F.col("settled")), "provisional").otherwise("final").alias("finality"),
            F.when(F.col("id") % 5 == 0, "etherscan").otherwise("arkham").alias("source_name"), (F.col("id") % 97 == 0).alias("annotated"), "kind",
        )


def wei(amount: str = "amount", key: str = "id"):
    """WEI_SQL as a column."""
    return F.concat(F.col(amount).cast("string"), F.lpad((F.col(key) * 999_983 % 10**15).cast("string"), 23, "0"))


def _name(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))
