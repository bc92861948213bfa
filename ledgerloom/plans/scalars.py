"""Queries of the scalar functions over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from .registry import Registry

REGISTRY = query = Registry()

def _hex():
    return F.lpad(F.hex("c_custkey"), 40, "0")


@query("scl_01", """SELECT c_custkey AS id,
  CASE c_custkey % 4 WHEN 0 THEN '0x' || lower(lpad(hex(c_custkey), 40, '0')) WHEN 1 THEN 'bc1q' || c_custkey WHEN 2 THEN '1Pq' || c_custkey || 'X' END AS address,
  CASE WHEN c_custkey % 4 = 3 THEN 'malformed hex address' END AS error FROM customer""")
def scl_01(d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.upper(_hex()))).when(k % 4 == 1, F.concat(F.lit("BC1Q"), k)).when(k % 4 == 2, F.concat(F.lit(" 1Pq"), k, F.lit("X "))).otherwise(F.concat(F.lit("0xzz"), k))
    form, error = s.canonical_address(F.when(k % 4 % 3 == 0, "ethereum").otherwise("bitcoin"), raw)
    return d.read("customer").select(k.alias("id"), form.alias("address"), error.alias("error"))


@query("scl_02", """SELECT tx_id, CASE tx_id % 4 WHEN 3 THEN NULL WHEN 2 THEN block_ts - 7200 ELSE block_ts END AS ts FROM tx""")
def scl_02(d):
    k, at = F.col("tx_id"), F.timestamp_seconds("block_ts")
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k % 4 == 0, F.col("block_ts").cast("string")).when(k % 4 == 1, F.concat(iso, F.lit("Z"))).when(k % 4 == 2, F.concat(iso, F.lit("+02:00"))).otherwise("not a time")
    return d.tx.select("tx_id", F.unix_seconds(s.to_canonical_ts(raw)).alias("ts"))


@query("scl_03", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'evm' WHEN 1 THEN 'bitcoin' ELSE 'unknown' END AS family FROM customer""")
def scl_03(d):
    k = F.col("c_custkey")
    address = F.when(k % 3 == 0, F.concat(F.lit("0x"), _hex())).when(k % 3 == 1, F.concat(F.lit("bc1q"), F.lower(_hex()))).otherwise(F.concat(F.lit("acct-"), k))
    return d.read("customer").select(k.alias("id"), s.detect_chain(address).alias("family"))


@query("scl_04", """WITH tip AS (SELECT chain, max(block_height) AS tip FROM tx GROUP BY chain),
  c AS (SELECT tx_id, chain, coalesce(greatest(0, tip - block_height + 1), 0) AS confirmations FROM tx JOIN tip USING (chain))
  SELECT tx_id, confirmations, CASE WHEN confirmations >= CASE chain WHEN 'bitcoin' THEN 6 ELSE 64 END THEN 'final' ELSE 'provisional' END AS finality FROM c""")
def scl_04(d):
    tip = d.tx.groupBy("chain").agg(F.max("block_height").alias("tip"))
    n = s.confirmations(F.col("tip"), F.col("block_height"))
    return d.tx.join(tip, "chain").select("tx_id", n.alias("confirmations"), s.finality(F.col("chain"), n).alias("finality"))


@query("scl_05", """SELECT id, CASE WHEN value_e4 IS NOT NULL THEN (value_e4 // 10000) || '.' || lpad(CAST(value_e4 % 10000 AS VARCHAR), 4, '0') || '00000000000000' END AS value FROM valued""")
def scl_05(d):
    price = d.price.select("asset", F.col("price_ts").alias("block_ts"), (F.col("price_cents").cast("decimal(18,8)") / 100).cast("decimal(18,8)").alias("price"))
    return d.transfer.join(price, ["asset", "block_ts"], "left").select("id", s.compute_value(F.col("amount"), 2, F.col("price")).alias("value"))


@query("scl_06", """SELECT id, CASE WHEN amount <> 0 THEN CAST(amount % 7 + 2 AS VARCHAR) || '.500000000000000000' END AS unit_price FROM transfer""")
def scl_06(d):
    """The total is built as amount x (amount % 7 + 2.5), so the unit price comes back exactly."""
    total = s.shift_point((F.col("amount") * ((F.col("amount") % 7) * 10 + 25)).cast("decimal(38,0)"), 3)
    return d.transfer.select("id", s.exact_unit_price(total, F.col("amount").cast("string"), F.lit(2)).alias("unit_price"))


@query("scl_07", """SELECT id, CAST(amount * 10 AS VARCHAR) AS exact_amount, amount % 100 <> 0 AS truncation_risk,
  CAST(amount // 100 + CASE WHEN amount % 100 > 50 OR (amount % 100 = 50 AND (amount // 100) % 2 = 1) THEN 1 ELSE 0 END AS VARCHAR) AS rounded_amount, amount % 100 <> 0 AS rounded FROM transfer""")
def scl_07(d):
    """Amounts in cents shown as dollars: to three places exactly, to none by half-even rounding."""
    shown = s.shift_point(F.col("amount"), 2)
    exact, whole = s.to_base_units(shown, F.lit(3)), s.to_base_units(shown, F.lit(0))
    return d.transfer.select("id", exact["amount"].alias("exact_amount"), exact["truncation_risk"].alias("truncation_risk"), whole["amount"].alias("rounded_amount"), whole["rounded"].alias("rounded"))


@query("scl_08", """SELECT id, CASE WHEN amount % 100 = 0 THEN CAST(amount // 100 AS VARCHAR) WHEN amount % 10 = 0 THEN (amount // 100) || '.' || (amount % 100 // 10)
  ELSE (amount // 100) || '.' || lpad(CAST(amount % 100 AS VARCHAR), 2, '0') END || ' ' || asset AS label FROM transfer""")
def scl_08(d):
    return d.transfer.select("id", s.format_amount(F.col("amount"), 2, F.col("asset")).alias("label"))


@query("scl_10", """SELECT c_custkey AS id, left(c_name, 4) || '…' || right(c_name, 4) AS short, left(c_name, 11) || '…' AS capped FROM customer""")
def scl_10(d):
    return d.read("customer").select(F.col("c_custkey").alias("id"), s.short(F.col("c_name")).alias("short"), s.cap(F.col("c_name"), 12).alias("capped"))


@query("scl_11", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'p2tr' WHEN 1 THEN 'p2wpkh' WHEN 2 THEN 'p2wsh' WHEN 3 THEN 'p2pkh' WHEN 4 THEN 'p2sh' ELSE 'other' END AS kind FROM part""")
def scl_11(d):
    k = F.col("p_partkey")
    start = F.element_at(F.array(*map(F.lit, ("bc1p", "bc1q", "bc1q", "1P", "3x", "zz"))), (k % 6 + 1).cast("int"))
    return d.read("part").select(k.alias("id"), s.script_type(F.rpad(F.concat(start, k), F.when(k % 6 == 2, 62).otherwise(42), "q")).alias("kind"))


@query("scl_12", """SELECT c_custkey AS id, '0x' || lower(lpad(hex(c_custkey), 40, '0')) AS address, '0x' || lower(lpad(hex(c_custkey), 64, '0')) AS topic FROM customer""")
def scl_12(d):
    address = F.concat(F.lit("0x"), F.upper(_hex()))
    return d.read("customer").select(F.col("c_custkey").alias("id"), s.topic_address(s.address_topic(address)).alias("address"), s.address_topic(address).alias("topic"))


@query("scl_13", """SELECT l_orderkey * 100 + rn AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber END, rn) AS place FROM ln""")
def scl_13(d):
    from pyspark.sql import Window as W

    n = F.col("l_linenumber")
    trace = F.concat_ws("_", (n % 3).cast("string"), F.when(n % 4 == 0, "x").otherwise(n.cast("string")))
    return d.lines.select((F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(s.trace_key(trace), "rn")).cast("long").alias("place"))


@query("scl_14", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || CASE WHEN c_custkey % 3 <> 0 THEN ', ' || c_name ELSE '' END ELSE c_mktsegment END AS name FROM customer""")
def scl_14(d):
    k = F.col("c_custkey")
    return d.read("customer").select(k.alias("id"), s.entity_name(F.when(k % 3 != 0, F.col("c_name")), F.col("c_mktsegment"), F.when(k % 2 == 0, "Individual").otherwise("Entity")).alias("name"))


@query("scl_15", """SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 1e0 WHEN '2' THEN 0.5e0 WHEN '3' THEN 0.25e0 END AS confidence FROM orders""")
def scl_15(d):
    return d.read("orders").select(F.col("o_orderkey").alias("id"), (s.lookup({"1": 100, "2": 50, "3": 25}, F.left("o_orderpriority", F.lit(1))) / 100).alias("confidence"))


@query("scl_16", """SELECT event_id AS id, event_id % 5 > 2 AS truth FROM events""")
def scl_16(d):
    text = F.element_at(F.array(*map(F.lit, (" No ", "FALSE", "", "yes", "1"))), (F.col("event_id") % 5 + 1).cast("int"))
    return d.read("events").select(F.col("event_id").alias("id"), s.truthy(text).alias("truth"))


@query("scl_17", """SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN label WHEN id % 3 = 0 THEN source ELSE source || ' | ' || label END AS note FROM claim""")
def scl_17(d):
    i = F.col("id")
    return d.claim.select("id", s.note(F.when(i % 2 != 0, F.col("source")), F.when(i % 3 != 0, F.col("label"))).alias("note"))


@query("scl_18", """SELECT l_orderkey * 100 + rn AS id, CAST(CASE WHEN rn % 5 <> 0 THEN CAST(l_quantity AS BIGINT) * cents END AS VARCHAR) AS fee FROM ln""")
def scl_18(d):
    used, price = F.col("l_quantity").cast("long").cast("decimal(20,0)"), F.when(F.col("rn") % 5 != 0, F.col("cents").cast("decimal(18,0)"))
    return d.lines.select((F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), (used * price).cast("decimal(38,0)").cast("string").alias("fee"))


@query("scl_19", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '0000-' || lower(lpad(hex(c_custkey % 65536), 4, '0')) END AS key FROM customer""")
def scl_19(d):
    k = F.col("c_custkey")
    return d.read("customer").select(k.alias("id"), s.lookalike_key(F.when(k % 2 == 0, F.concat(F.lit("0x"), _hex())).otherwise(F.col("c_name"))).alias("key"))


@query("scl_20", """SELECT DISTINCT l_linenumber AS votes, CASE l_linenumber WHEN 0 THEN 4e-1 WHEN 1 THEN 55e-2 WHEN 2 THEN 7e-1 ELSE 85e-2 END AS confidence FROM lineitem""")
def scl_20(d):
    return d.read("lineitem").select(F.col("l_linenumber").alias("votes"), s.change_confidence(F.col("l_linenumber")).alias("confidence")).distinct()


@query("scl_21", """SELECT tx_id, CASE WHEN tx_id % 3 = 0 THEN chain || ':0xab' || tx_id WHEN chain = 'ethereum' THEN 'coingecko:ethereum' END AS price_key FROM tx""")
def scl_21(d):
    return d.tx.select("tx_id", s.price_key(F.col("chain"), F.when(F.col("tx_id") % 3 == 0, F.concat(F.lit("0xAB"), "tx_id")), {"ethereum": "ethereum"}).alias("price_key"))


@query("scl_22", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'ethereum' END AS chain, CASE o_orderkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' END AS native FROM orders""")
def scl_22(d):
    ticker = F.element_at(F.array(*map(F.lit, ("XBT", "ETH", "DOGE"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    chain = s.lookup({"XBT": "bitcoin", "BTC": "bitcoin", "ETH": "ethereum"}, ticker)
    return d.read("orders").select(F.col("o_orderkey").alias("id"), chain.alias("chain"), s.lookup({"bitcoin": "BTC", "ethereum": "ETH"}, chain).alias("native"))


@query("scl_23", """SELECT event_id AS id, event_type = 'error' OR event_id % 9 = 0 AS failed FROM events""")
def scl_23(d):
    return d.read("events").select(F.col("event_id").alias("id"), s.is_failed(F.when(F.col("event_id") % 9 == 0, "1").otherwise("0"), F.concat(F.lit("Status: "), F.initcap("event_type"))).alias("failed"))


@query("scl_24", """SELECT chain, status, CASE WHEN status = 'failed' THEN upper(left(chain, 1)) || substr(chain, 2) || ' cluster' ELSE 'Co-spend cluster' END || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' address)' ELSE ' addresses)' END AS name FROM tx GROUP BY chain, status""")
def scl_24(d):
    return d.tx.groupBy("chain", "status").agg(F.count(F.lit(1)).alias("n")).select("chain", "status", s.cluster_name(F.col("chain"), F.when(F.col("status") == "success", "co-spend"), F.col("n")).alias("name"))


@query("scl_25", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN left(c_name || ' ' || c_name || ' ' || c_name || ' ' || c_name || ' ' || c_name, 79) || '…' END AS clipped FROM customer""")
def scl_25(d):
    return d.read("customer").select(F.col("c_custkey").alias("id"), s.clip(F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", *["c_name"] * 5)).otherwise("   ")).alias("clipped"))


@query("scl_26", """SELECT tx_id, sha256(CAST(to_json({'block_height': block_height, 'block_ts': block_ts, 'chain': chain, 'status': status, 'tx_id': tx_id}) AS VARCHAR)) AS row_hash FROM tx""")
def scl_26(d):
    return d.tx.select("tx_id", s.row_hash("tx_id", "chain", "block_height", "block_ts", "status").alias("row_hash"))


@query("scl_27", """SELECT id, CASE WHEN amount = 0 THEN 'none' WHEN value_e4 IS NULL THEN 'unvalued' ELSE 'valued' END AS state FROM valued""")
def scl_27(d):
    return d.valued.select("id", s.valuation_state(F.col("value_e4"), F.col("amount") != 0).alias("state"))


@query("scl_28", """SELECT event_id AS id, k, CAST(NULL AS VARCHAR) AS missing FROM ev""")
def scl_28(d):
    params = F.col("props")
    return d.read("events").select(F.col("event_id").alias("id"), F.get_json_object(params, "$.k").cast("long").alias("k"), F.get_json_object(F.concat(F.lit("{"), params), "$.k").alias("missing"))


@query("scl_29", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS edition FROM orders""")
def scl_29(d):
    text = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("13/45/1999")
    return d.read("orders").select(F.col("o_orderkey").alias("id"), s.parse_edition_date(text).cast("string").alias("edition"))


@query("scl_30", """SELECT id, unnest(['bounds.k', 'partial', 'window']) AS key, unnest([CAST(k AS VARCHAR), CASE WHEN status = 'partial' THEN 'yes' ELSE 'no' END, '—']) AS value FROM source_query JOIN (SELECT event_id AS id, k FROM ev) USING (id)""")
def scl_30(d):
    k = F.get_json_object("params", "$.k")
    return d.source_query.select("id", F.expr("stack(3, 'bounds.k', get_json_object(params, '$.k'), 'partial', if(status = 'partial', 'yes', 'no'), 'window', '—') as (key, value)"))


@query("scl_31", """SELECT tx_id, CASE tx_id % 3 WHEN 0 THEN 'co-spend' WHEN 1 THEN '2 change heuristics, ' || (tx_id % 5) || ' agree' ELSE '1 change heuristics' END AS label FROM tx""")
def scl_31(d):
    k = F.col("tx_id")
    method = F.when(k % 3 == 0, "co-spend").when(k % 3 == 1, F.concat(F.lit("change:address-reuse+fresh@agree>="), k % 5)).otherwise("change:peeling")
    return d.tx.select("tx_id", s.concise_method(method).alias("label"))


@query("udf_01", """SELECT id, CASE WHEN value_e4 IS NOT NULL THEN (value_e4 // 10000) || '.' || lpad(CAST(value_e4 % 10000 AS VARCHAR), 4, '0') || '00000000000000' END AS value FROM valued""")
def udf_01(d):
    """Amounts far beyond 38 digits: 50 more digits, taken back by the decimals."""
    price = d.price.select("asset", F.col("price_ts").alias("block_ts"), s.shift_point(F.col("price_cents"), 2).alias("price"))
    return d.transfer.join(price, ["asset", "block_ts"], "left").select("id", s.exact_value(F.concat(F.col("amount"), F.lit("0" * 50)), F.lit(52), F.col("price")).alias("value"))
