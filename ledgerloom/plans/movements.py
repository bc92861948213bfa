"""Queries of movements, valuation, filters, rankings and tracing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import movements as m
from ..operators import tracing as t
from ..operators.graph import default_focus, find_focus, magnitude, neighbour_order
from .fixtures import WEI_SQL, wei
from .registry import Registry

REGISTRY = query = Registry()


@query("jon_01", "SELECT * FROM movement")
def jon_01(d):
    return m.movement_view(d.transfer, d.tx_output)


@query("jon_02", "SELECT subject_type, m.id, m.dst AS address, m.asset, m.amount, value_e4 AS value FROM movement m LEFT JOIN valued v ON subject_type = 'transfer' AND m.id = v.id")
def jon_02(d):
    values = d.valued.filter("value_e4 is not null").select(F.lit("transfer").alias("subject_type"), "id", F.col("value_e4").alias("value"))
    return m.address_flow(m.movement_view(d.transfer, d.tx_output), values)


@query("jon_03", "SELECT m.subject_type, m.id, q.connector, q.capability FROM movement m LEFT JOIN source_query q ON q.id = m.tx_id")
def jon_03(d):
    return m.with_acquiring_source(m.movement_view(d.transfer, d.tx_output).withColumn("query_id", F.col("tx_id")), d.source_query).select("subject_type", "id", "connector", "capability")


@query("jon_04", "SELECT o.id, o.tx_id, i.tx_id AS spending_tx_id, i.tx_id IS NOT NULL AS spent FROM tx_output o LEFT JOIN (SELECT prev_output_id, min(tx_id) AS tx_id FROM tx_input GROUP BY 1) i ON prev_output_id = o.id")
def jon_04(d):
    return m.resolve_spends(d.tx_input, d.tx_output)[1].select("id", "tx_id", "spending_tx_id", "spent")


@query("jon_05", "SELECT subject_type, m.id, m.amount FROM movement m WHERE NOT EXISTS (SELECT 1 FROM valued v WHERE subject_type = 'transfer' AND v.id = m.id AND value_e4 IS NOT NULL AND v.id % 3 <> 0)")
def jon_05(d):
    values = d.valued.filter("value_e4 is not null").select(F.lit("transfer").alias("subject_type"), "id", F.when(F.col("id") % 3 == 0, "export").otherwise("feed").alias("source"))
    return m.unvalued(m.movement_view(d.transfer, d.tx_output), values, "feed").select("subject_type", "id", "amount")


@query("jon_06", "SELECT id, value_e4, CASE WHEN value_e4 IS NULL THEN 'no price' ELSE 'valued' END AS outcome FROM valued")
def jon_06(d):
    feed = d.price.select(F.col("asset").alias("price_key"), F.col("price_ts").alias("ts"), F.col("price_cents").alias("price"))
    old = F.col("ts") % 172800 == 0
    rows = d.transfer.select("id", "amount", F.col("asset").alias("price_key"), F.col("block_ts").alias("ts"))
    return m.attach_prices(rows, feed.filter(old), feed.filter(~old)).select("id", (F.col("amount") * F.col("unit_price")).alias("value_e4"), "outcome")


_moved = "(SELECT m.*, CASE WHEN subject_type = 'transfer' THEN value_e4 END AS value, m.asset IN ('Brand#1', 'BTC') AS native FROM movement m LEFT JOIN valued v ON subject_type = 'transfer' AND v.id = m.id)"


@query("agg_02", f"""SELECT address, nullif(sum(value) FILTER (WHERE side = 'in'), 0)::BIGINT AS received_value, nullif(sum(value) FILTER (WHERE side = 'out'), 0)::BIGINT AS sent_value,
  nullif(sum(amount) FILTER (WHERE side = 'in' AND native), 0)::BIGINT AS received_native, nullif(sum(amount) FILTER (WHERE side = 'out' AND native), 0)::BIGINT AS sent_native
  FROM (SELECT dst AS address, 'in' AS side, value, amount, native FROM {_moved} UNION ALL SELECT src, 'out', value, amount, native FROM {_moved} WHERE src IS NOT NULL
        UNION ALL SELECT address, 'out', NULL, amount, true FROM tx_input) GROUP BY address""")
def agg_02(d):
    rows = m.movement_view(d.valued.withColumns({"chain": F.lit("ethereum"), "value": F.col("value_e4")}), d.tx_output, value=True)
    return m.address_totals(rows, d.tx_input, F.col("asset").isin("Brand#1", "BTC"))


@query("agg_01", """SELECT source, target, asset, kind, count(*) AS count, sum(amount)::BIGINT AS amount, sum(value_e4)::BIGINT AS value_e4, max(finality) AS finality, count(*) FILTER (WHERE value_e4 IS NULL) AS no_price,
  array_to_string(list_sort(list(DISTINCT source_name)), ',') AS source_names FROM edge WHERE NOT annotated GROUP BY ALL
  UNION ALL SELECT source, target, asset, kind, 1, amount, value_e4, finality, CASE WHEN value_e4 IS NULL THEN 1 ELSE 0 END, source_name FROM edge WHERE annotated""")
def agg_01(d):
    return m.rollup_parallel(d.edge, F.col("annotated"))


@query("agg_01_members", "SELECT source, target, asset, kind, id FROM edge WHERE NOT annotated")
def agg_01_members(d):
    return m.rollup_members(d.edge, F.col("annotated"))


_wei_valued = f"(SELECT v.*, CAST({WEI_SQL.format(amount='amount', id='id')} AS HUGEINT) AS wei, CAST({WEI_SQL.format(amount='amount', id='id')} AS HUGEINT) * price_cents AS wei_value FROM transfer v LEFT JOIN price p ON p.asset = v.asset AND p.price_ts = v.block_ts)"
_wei_output = f"(SELECT *, CAST({WEI_SQL.format(amount='amount', id='id')} AS HUGEINT) AS wei FROM tx_output)"
_wei_input = f"(SELECT *, CAST({WEI_SQL.format(amount='amount', id='prev_output_id')} AS HUGEINT) AS wei FROM tx_input)"


def _wei_transfers(d):
    """Transfers with amounts given in text, read once, and their values: exact products of amount and unit price; both are exact numbers."""
    price = d.price.withColumnRenamed("price_ts", "block_ts")
    given = d.transfer.withColumn("amount", wei()).join(price, ["asset", "block_ts"], "left")
    return exact.multiplied(exact.numbers(given, "amount"), "value_e4", "amount", "price_cents")


@query("agg_02_wei", f"""SELECT address, nullif(CAST(sum(value) FILTER (WHERE side = 'in') AS VARCHAR), '0') AS received_value, nullif(CAST(sum(value) FILTER (WHERE side = 'out') AS VARCHAR), '0') AS sent_value,
  nullif(CAST(sum(wei) FILTER (WHERE side = 'in' AND native) AS VARCHAR), '0') AS received_native, nullif(CAST(sum(wei) FILTER (WHERE side = 'out' AND native) AS VARCHAR), '0') AS sent_native
  FROM (SELECT dst AS address, 'in' AS side, wei_value AS value, wei, asset = 'Brand#1' AS native FROM {_wei_valued} UNION ALL SELECT src, 'out', wei_value, wei, asset = 'Brand#1' FROM {_wei_valued}
        UNION ALL SELECT address, 'in', NULL, wei, true FROM {_wei_output} UNION ALL SELECT address, 'out', NULL, wei, true FROM {_wei_input}) GROUP BY address""")
def agg_02_wei(d):
    read = lambda rows, key="id": exact.numbers(rows.withColumn("amount", wei(key=key)), "amount")
    rows = m.movement_view(_wei_transfers(d).withColumn("value", F.col("value_e4")), read(d.tx_output), value=True)
    return m.address_totals(rows, read(d.tx_input, "prev_output_id"), F.col("asset").isin("Brand#1", "BTC"))


@query("agg_01_wei", f"""SELECT src AS source, dst AS target, asset, kind, count(*) AS count, CAST(sum(wei) AS VARCHAR) AS amount, CAST(sum(wei_value) AS VARCHAR) AS value_e4, count(*) FILTER (WHERE wei_value IS NULL) AS no_price
  FROM {_wei_valued} GROUP BY ALL""")
def agg_01_wei(d):
    edges = _wei_transfers(d).select("id", F.col("src").alias("source"), F.col("dst").alias("target"), "asset", "kind", "amount", "value_e4", F.lit("final").alias("finality"), F.lit("etherscan").alias("source_name"))
    return m.rollup_parallel(edges, F.lit(False)).drop("finality", "source_names")


@query("win_01", "SELECT id, row_number() OVER (PARTITION BY tx_id, src, dst, asset, amount, kind ORDER BY id) - 1 AS occurrence FROM transfer")
def win_01(d):
    return m.occurrences(d.transfer, ["tx_id", "src", "dst", "asset", "amount", "kind"], ["id"]).select("id", "occurrence")


@query("win_02", "SELECT l_orderkey * 100 + rn AS id, rn - 1 AS position FROM ln")
def win_02(d):
    return d.lines.select((F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), (F.col("rn") - 1).alias("position"))


@query("win_03", "SELECT address, id FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY coalesce(block_height, 4611686018427387904), output_index, id) AS n FROM tx_output) WHERE n = 1")
def win_03(d):
    order = W.partitionBy("address").orderBy(F.coalesce("block_height", F.lit(2**62)), "output_index", "id")
    return d.tx_output.withColumn("n", F.row_number().over(order)).filter("n = 1").select("address", "id")


@query("win_07", """SELECT id, max_by(value, conf * 1000000000000000 + value) AS value, count(*) > 1 AS contested FROM (
  SELECT id, value_e4 AS value, 2 AS conf FROM valued WHERE value_e4 IS NOT NULL UNION ALL SELECT id, value_e4 + id % 7 - 3, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END FROM valued WHERE value_e4 IS NOT NULL AND id % 4 < 2) GROUP BY id""")
def win_07(d):
    kind = F.lit("transfer").alias("subject_type")
    v = d.valued.filter("value_e4 is not null")
    claims = v.select(kind, "id", F.col("value_e4").alias("value"), F.lit(0.2).alias("confidence")).unionByName(
        v.filter("id % 4 < 2").select(kind, "id", (F.col("value_e4") + F.col("id") % 7 - 3).alias("value"), F.when(F.col("id") % 2 == 0, 0.2).alias("confidence"))
    )
    return m.representative_value(claims).drop("subject_type")


@query("win_08", "SELECT id, CAST(sum(amount) OVER (PARTITION BY tx_id ORDER BY output_index) AS BIGINT) AS hi FROM tx_output")
def win_08(d):
    return m.running(d.tx_output, "tx_id", "output_index").select("id", "hi")


@query("win_08_wei", f"SELECT id, CAST(sum(wei) OVER w AS VARCHAR) AS hi, CAST(sum(wei) OVER w - wei AS VARCHAR) AS lo FROM {_wei_output} WINDOW w AS (PARTITION BY tx_id ORDER BY output_index)")
def win_08_wei(d):
    return m.running(d.tx_output.withColumn("amount", wei()), "tx_id", "output_index").select("id", *(exact.text(F.col(c)).alias(c) for c in ("hi", "lo")))


@query("win_09", """WITH e AS (SELECT target AS hub, 'in' AS direction, source AS other, value_e4, amount FROM edge UNION ALL SELECT source, 'out', target, value_e4, amount FROM edge),
  g AS (SELECT hub, direction, other, sum(value_e4)::BIGINT AS value_e4, sum(amount)::BIGINT AS amount FROM e GROUP BY ALL)
  SELECT hub, direction, other, value_e4, amount, CASE WHEN n <= 20 THEN n END AS place, n > 20 AS folded
  FROM (SELECT *, row_number() OVER (PARTITION BY hub, direction ORDER BY value_e4 IS NOT NULL, coalesce(value_e4, amount) DESC, other) AS n FROM g)""")
def win_09(d):
    return m.capped_counterparties(d.edge, 20)


_order = lambda mode, key, asset: f"""SELECT '{mode}' AS mode, node, CASE WHEN key IS NULL THEN '' ELSE asset END AS asset, key, CASE WHEN key IS NOT NULL THEN row_number() OVER (PARTITION BY key IS NULL ORDER BY asset, key, node) END AS place, key IS NULL AS tray
  FROM (SELECT node, max(key) AS key, min(asset) FILTER (WHERE key = best) AS asset FROM (SELECT *, max(key) OVER (PARTITION BY node) AS best FROM (SELECT CASE WHEN source = 's7' THEN target ELSE source END AS node, {asset} AS asset, {key} AS key FROM seen WHERE (source = 's7') <> (target = 's7'))) GROUP BY node)"""  # noqa: E731


@query("win_10", "WITH seen AS (SELECT e.*, block_height AS seq FROM edge e JOIN transfer USING (id)) " + " UNION ALL ".join((_order("value", "value_e4", "''"), _order("sequence", "seq", "''"), _order("native", "CASE WHEN amount > 0 THEN amount END", "asset"))))
def win_10(d):
    """The neighbours of one supplier, by each of the three modes."""
    edges = d.edge.join(d.transfer.select("id", F.col("block_height").alias("seq")), "id").withColumn("kind", F.lit("transfer")).withColumnRenamed("value_e4", "value")
    parts = [neighbour_order(edges, "s7", mode).withColumn("mode", F.lit(mode)) for mode in ("value", "sequence", "native")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("win_13", """WITH x AS (SELECT id, CASE WHEN value_e4 > 0 THEN '' ELSE asset END AS scale, CASE WHEN value_e4 > 0 THEN ln(value_e4) WHEN value_e4 IS NULL AND amount > 0 THEN ln(amount) END AS x FROM edge),
  r AS (SELECT scale, min(x) AS a, max(x) AS b FROM x GROUP BY scale)
  SELECT id, CASE WHEN x IS NULL THEN 150 ELSE CAST(round((1.5 + greatest(0.0, least(1.0, CASE WHEN b > a THEN (x - a) / (b - a) ELSE 0.5 END)) * 6.5) * 100) AS BIGINT) END AS width_hundredths FROM x JOIN r USING (scale)""")
def win_13(d):
    return m.edge_widths(d.edge).select("id", F.round(F.col("width") * 100).cast("long").alias("width_hundredths"))


@query("flt_01", "SELECT id FROM transfer WHERE dst = 's10' AND (asset <> 'Brand#1' OR amount >= 500000)")
def flt_01(d):
    return d.transfer.filter((F.lower("dst") == "s10") & ((F.col("asset") != "Brand#1") | (F.col("amount") >= 500_000))).select("id")


@query("flt_02", "SELECT id FROM transfer WHERE block_height BETWEEN 10000 AND 12000")
def flt_02(d):
    return d.transfer.filter(F.col("block_height").between(10_000, 12_000)).select("id")


@query("flt_03", """WITH w AS (SELECT greatest(5000, min(block_height) FILTER (WHERE block_ts >= 852076800)) AS a, least(9000, max(block_height) FILTER (WHERE block_ts <= 883612800)) AS b FROM tx WHERE chain = 'ethereum')
  SELECT tx_id FROM tx, w WHERE chain = 'ethereum' AND block_height BETWEEN a AND b""")
def flt_03(d):
    tx, h = d.tx.filter("chain = 'ethereum'"), F.col("block_height")
    window = tx.agg(F.greatest(F.lit(5000), F.min(F.when(F.col("block_ts") >= 852076800, h))).alias("a"), F.least(F.lit(9000), F.max(F.when(F.col("block_ts") <= 883612800, h))).alias("b"))
    return tx.join(F.broadcast(window), h.between(F.col("a"), F.col("b"))).select("tx_id")


@query("flt_04", """SELECT src, id, n > 5 AS partial FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY block_height NULLS FIRST, id) AS place, count(*) OVER (PARTITION BY src) AS n FROM transfer) WHERE place <= 5""")
def flt_04(d):
    return m.bounded_pull(d.transfer, "src", ["block_height", "id"], 5).select("src", "id", "partial")


@query("flt_05", "SELECT a.address, a.label FROM attribution a WHERE a.address IN (SELECT src FROM transfer UNION SELECT dst FROM transfer)")
def flt_05(d):
    known = d.transfer.select(F.col("src").alias("address")).unionByName(d.transfer.select(F.col("dst").alias("address"))).distinct()
    return d.attribution.join(known, "address", "left_semi").select("address", "label")


@query("flt_06", "SELECT id FROM edge WHERE (value_e4 IS NULL OR value_e4 >= 500000000) AND (asset <> 'Brand#2' OR amount >= 1000000)")
def flt_06(d):
    return d.edge.filter((F.col("value_e4").isNull() | (F.col("value_e4") >= 500_000_000)) & ((F.col("asset") != "Brand#2") | (F.col("amount") >= 1_000_000))).select("id")


@query("flt_07", "SELECT id, CASE WHEN value_e4 IS NOT NULL THEN value_e4 < 300000000 ELSE amount < 1000000 END AS dust FROM edge")
def flt_07(d):
    return d.edge.select("id", F.when(F.col("value_e4").isNotNull(), F.col("value_e4") < 300_000_000).otherwise(F.col("amount") < 1_000_000).alias("dust"))


@query("flt_08", "SELECT c.address, EXISTS (SELECT 1 FROM risk r WHERE r.address = c.address) OR c.category = 'exchange' AS flagged FROM attribution c WHERE source = 'segment'")
def flt_08(d):
    risky = d.risk.select("address").distinct().withColumn("risky", F.lit(True))
    return d.attribution.filter("source = 'segment'").join(risky, "address", "left").select("address", (F.coalesce("risky", F.lit(False)) | (F.col("category") == "exchange")).alias("flagged"))


@query("flt_09", "SELECT id, 'usd' AS basis, value_e4 AS magnitude FROM edge WHERE value_e4 IS NULL OR value_e4 >= 50000000 UNION ALL SELECT id, 'native', amount FROM edge WHERE amount >= 500000")
def flt_09(d):
    """Edges of half a kilo-dollar or more in either basis; an edge without a price passes a floor of value."""
    rows = d.edge.withColumnRenamed("value_e4", "value")
    parts = [rows.select("id", F.lit(basis).alias("basis"), magnitude(basis).alias("magnitude")).filter(F.col("magnitude").isNull() | (F.col("magnitude") >= least)) for basis, least in (("usd", 50_000_000), ("native", 500_000))]
    return parts[0].unionByName(parts[1])


_texts = ["addr:c7", " C12 ", "c1", "S", "nobody", ""]


@query("flt_10", f"""WITH n AS (SELECT DISTINCT 'addr:' || address AS id, address FROM attribution UNION SELECT 'addr:' || address, address FROM exchange), q(text, q) AS (VALUES {", ".join(f"('{t}', '{t.strip().lower()}')" for t in _texts)}),
  top AS (SELECT 'addr:' || node AS node FROM (SELECT source AS node FROM edge UNION ALL SELECT target FROM edge) GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
  hit AS (SELECT text, (SELECT min(id) FROM n WHERE id = text) AS a, (SELECT min(id) FROM n WHERE lower(address) = q AND q <> '') AS b, (SELECT min(id) FROM n WHERE starts_with(lower(address), q) AND q <> '') AS c FROM q)
  SELECT text, coalesce(a, b, c, (SELECT node FROM top)) AS node, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'prefix' ELSE 'default' END AS how FROM hit""")
def flt_10(d):
    """The texts are what users ask for: an id, an address, a beginning, and two that find nothing."""
    node = lambda c: F.concat(F.lit("addr:"), c)
    nodes = d.attribution.select("address").unionByName(d.exchange).distinct().select(node("address").alias("id"), "address")
    return find_focus(nodes, _texts, default_focus(d.edge.select(node("source").alias("source"), node("target").alias("target"))))


@query("flt_11", "SELECT id FROM edge WHERE source = 's7' OR target = 's7'")
def flt_11(d):
    return d.edge.filter("source = 's7' or target = 's7'").select("id")


@query("flt_12", "SELECT id, NOT native AND NOT listed AND asset <> 'Brand#3' AS unverified FROM transfer JOIN asset USING (asset)")
def flt_12(d):
    return d.transfer.join(d.asset, "asset").select("id", (~F.col("native") & ~F.col("listed") & ~F.upper("asset").isin("BRAND#3")).alias("unverified"))


@query("flt_13", "SELECT DISTINCT address FROM attribution WHERE contains(lower(category), 'exchange')")
def flt_13(d):
    return d.attribution.filter(F.lower("category").contains("exchange")).select("address").distinct()


@query("flt_14", f"SELECT id, src, dst, asset, CAST(wei AS VARCHAR) AS amount, block_height FROM {_wei_valued} WHERE src IS NOT NULL AND dst IS NOT NULL")
def flt_14(d):
    return m.clustering_transfers(d.transfer.withColumn("amount", wei()))


_fifo = """WITH a AS (SELECT tx_id, prev_output_id AS source_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY input_index) AS hi FROM tx_input),
  b AS (SELECT tx_id, id AS dest_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY output_index) AS hi FROM tx_output),
  link AS (SELECT a.tx_id, source_id, dest_id, CAST(least(a.hi, b.hi) - greatest(a.hi - a.amount, b.hi - b.amount) AS BIGINT) AS amount FROM a JOIN b ON a.tx_id = b.tx_id AND a.hi - a.amount < b.hi AND b.hi - b.amount < a.hi)
"""


def _links(d):
    return t.trace_transactions(d.tx_input, d.tx_output)[0]


@query("trc_01", _fifo + "SELECT * FROM link WHERE amount > 0")
def trc_01(d):
    return t.fifo_apportion(d.tx_input.select("tx_id", F.col("prev_output_id").alias("id"), "input_index", "amount"), d.tx_output)


@query("trc_01_wei", f"""WITH a AS (SELECT tx_id, prev_output_id AS source_id, wei AS amount, sum(wei) OVER (PARTITION BY tx_id ORDER BY input_index) AS hi FROM {_wei_input}),
  b AS (SELECT tx_id, id AS dest_id, wei AS amount, sum(wei) OVER (PARTITION BY tx_id ORDER BY output_index) AS hi FROM {_wei_output})
  SELECT a.tx_id, source_id, dest_id, CAST(least(a.hi, b.hi) - greatest(a.hi - a.amount, b.hi - b.amount) AS VARCHAR) AS amount FROM a JOIN b ON a.tx_id = b.tx_id AND a.hi - a.amount < b.hi AND b.hi - b.amount < a.hi
  WHERE a.amount > 0 AND b.amount > 0""")
def trc_01_wei(d):
    inputs = d.tx_input.select("tx_id", F.col("prev_output_id").alias("id"), "input_index", wei(key="prev_output_id").alias("amount"))
    return t.fifo_apportion(inputs, d.tx_output.withColumn("amount", wei()))


@query("jon_16", _fifo + "SELECT tx_id, count(*) AS links, sum(amount)::BIGINT AS linked FROM link WHERE amount > 0 GROUP BY tx_id")
def jon_16(d):
    return _links(d).groupBy("tx_id").agg(F.count(F.lit(1)).alias("links"), F.sum("amount").alias("linked"))


@query("trc_02", """WITH known AS (SELECT * FROM tx_input WHERE prev_output_id % 11 <> 0),
  a AS (SELECT tx_id, prev_output_id AS source_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY input_index) AS hi FROM known),
  b AS (SELECT tx_id, id AS dest_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY output_index) AS hi FROM tx_output),
  link AS (SELECT a.tx_id, source_id, dest_id, CAST(least(a.hi, b.hi) - greatest(a.hi - a.amount, b.hi - b.amount) AS BIGINT) AS amount FROM a JOIN b ON a.tx_id = b.tx_id AND a.hi - a.amount < b.hi AND b.hi - b.amount < a.hi)
  SELECT tx_id, count(*) FILTER (WHERE amount > 0) AS links, sum(amount)::BIGINT AS linked, coalesce(any_value(unresolved), 0) AS unresolved FROM link LEFT JOIN (SELECT tx_id, count(*) AS unresolved FROM tx_input WHERE prev_output_id % 11 = 0 GROUP BY 1) USING (tx_id) GROUP BY tx_id""")
def trc_02(d):
    """Outputs whose id is divisible by 11 are unknown to the ledger as sources."""
    inputs = d.tx_input.withColumn("prev_output_id", F.when(F.col("prev_output_id") % 11 == 0, -F.col("prev_output_id")).otherwise(F.col("prev_output_id")))
    links, missing = t.trace_transactions(inputs, d.tx_output)
    return links.groupBy("tx_id").agg(F.count(F.lit(1)).alias("links"), F.sum("amount").alias("linked")).join(missing, "tx_id", "left").select("tx_id", "links", "linked", F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"))


_pieces = """WITH a AS (SELECT tx_id, prev_output_id AS source_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY input_index) AS hi FROM tx_input),
  b AS (SELECT tx_id, id AS dest_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY output_index) AS hi FROM tx_output),
  piece AS (SELECT source_id, dest_id, lo - a_lo AS source_at, lo - b_lo AS dest_at, hi - lo AS amount FROM (
    SELECT source_id, dest_id, a.hi - a.amount AS a_lo, b.hi - b.amount AS b_lo, greatest(a.hi - a.amount, b.hi - b.amount) AS lo, least(a.hi, b.hi) AS hi
    FROM a JOIN b ON a.tx_id = b.tx_id AND a.hi - a.amount < b.hi AND b.hi - b.amount < a.hi) WHERE hi > lo),
  t0 AS (SELECT id AS output_id, 0::HUGEINT AS lo, amount::HUGEINT AS hi FROM tx_output WHERE tx_id % 100 = 1 AND amount > 0)"""
_hop = lambda n: f"""t{n} AS (SELECT dest_id AS output_id, dest_at - source_at + greatest(lo, source_at) AS lo, dest_at - source_at + least(hi, source_at + p.amount) AS hi
  FROM t{n - 1} JOIN piece p ON source_id = output_id AND lo < source_at + p.amount AND source_at < hi)"""  # noqa: E731
_taint = _pieces + ", " + ", ".join(map(_hop, (1, 2, 3))) + ", tainted AS (" + " UNION ALL ".join(f"SELECT output_id, lo::BIGINT AS lo, hi::BIGINT AS hi, {n} AS hop FROM t{n}" for n in range(4)) + ")"


def _tainted(d):
    """From the outputs of every hundredth transaction on, three hops far: the starting set is an argument of the operator."""
    pieces = t.fifo_intervals(d.tx_input.select("tx_id", F.col("prev_output_id").alias("id"), "input_index", "amount"), d.tx_output)
    return t.taint(pieces, d.tx_output.filter("tx_id % 100 = 1").select(F.col("id").alias("output_id"), "amount"), 3)


@query("trc_03", _taint + " SELECT * FROM tainted")
def trc_03(d):
    return _tainted(d)


@query("trc_03_balance", _taint + """ SELECT hop, sum(hi - lo)::BIGINT AS units, coalesce((SELECT sum(n.hi - n.lo) FROM tainted n WHERE n.hop = t.hop + 1), 0)::BIGINT AS moved,
  CASE WHEN hop < 3 THEN (coalesce(sum(hi - lo) FILTER (spent), 0) - coalesce((SELECT sum(n.hi - n.lo) FROM tainted n WHERE n.hop = t.hop + 1), 0))::BIGINT END AS fee, coalesce(sum(hi - lo) FILTER (NOT spent), 0)::BIGINT AS resting
  FROM (SELECT *, output_id IN (SELECT prev_output_id FROM tx_input) AS spent FROM tainted) t GROUP BY hop""")
def trc_03_balance(d):
    return t.taint_balance(_tainted(d), d.tx_input)


@query("trc_04", _fifo + """SELECT source_id, dest_id, s.address AS source, e.address AS target, l.amount FROM link l LEFT JOIN tx_output s ON s.id = source_id LEFT JOIN tx_output e ON e.id = dest_id WHERE l.amount > 0 AND source_id % 7 <> 0""")
def trc_04(d):
    gone = d.tx_output.filter("id % 7 = 0").select(F.col("id").alias("source_id"))
    ends = lambda key, name: d.tx_output.select(F.col("id").alias(key), F.col("address").alias(name))
    return t.effective(_links(d), gone, "source_id").join(ends("source_id", "source"), "source_id", "left").join(ends("dest_id", "target"), "dest_id", "left").select("source_id", "dest_id", "source", "target", "amount")


@query("trc_05", "SELECT id FROM transfer WHERE id % 7 = 0 OR id % 11 = 0")
def trc_05(d):
    asked = d.transfer.filter("id % 11 = 0").select("id").unionByName(d.transfer.filter("id % 11 = 0").select((-F.col("id") - 1).alias("id")))
    done = d.transfer.filter("id % 7 = 0").select("id")
    once = t.retract(d.transfer, done, asked, "id")
    return t.retract(d.transfer, once, asked, "id")


@query("aud_14", _fifo + "SELECT 'output' AS side, dest_id AS id, sum(l.amount)::BIGINT AS linked, any_value(o.amount) - 1000000 AS amount FROM link l JOIN tx_output o ON o.id = dest_id WHERE l.amount > 0 GROUP BY dest_id HAVING sum(l.amount) > any_value(o.amount) - 1000000")
def aud_14(d):
    """Outputs are stated a million lower than they are, so that those nearly full show."""
    inputs = d.tx_input.select(F.col("prev_output_id").alias("id"), "amount")
    return t.conservation(_links(d), inputs, d.tx_output.withColumn("amount", F.col("amount") - 1_000_000))


@query("jon_07", "SELECT id, src, dst, amount, id % 2 = 0 AS is_convention FROM transfer WHERE id % 7 <> 0")
def jon_07(d):
    return t.effective(d.transfer, d.transfer.filter("id % 7 = 0").select("id"), "id").select("id", "src", "dst", "amount", (F.col("id") % 2 == 0).alias("is_convention"))


@query("jon_11", """WITH known AS (SELECT * FROM transfer WHERE tx_id % 100 = 0 AND id % 7 <> 0), front AS (SELECT dst AS address FROM known EXCEPT SELECT src FROM known)
  SELECT id, src, dst, amount FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY amount DESC, id) AS n FROM transfer WHERE src IN (SELECT address FROM front) AND id NOT IN (SELECT id FROM known)) WHERE n <= 3""")
def jon_11(d):
    known = d.transfer.filter("tx_id % 100 = 0 and id % 7 <> 0")
    front = known.select(F.col("dst").alias("address")).distinct().join(known.select(F.col("src").alias("address")), "address", "left_anti")
    return m.next_hops(front, d.transfer, known, 3).select("id", "src", "dst", "amount")


@query("jon_12", _fifo + "SELECT DISTINCT dest_id AS output_id, i.tx_id AS spending_tx_id FROM link JOIN tx_input i ON i.prev_output_id = dest_id WHERE link.amount > 0 AND link.tx_id % 50 = 1 AND dest_id NOT IN (SELECT source_id FROM link WHERE tx_id % 50 = 1 AND amount > 0)")
def jon_12(d):
    own = _links(d).filter("tx_id % 50 = 1")
    open_ = own.select(F.col("dest_id").alias("output_id")).distinct().join(own.select(F.col("source_id").alias("output_id")), "output_id", "left_anti")
    return open_.join(d.tx_input.select(F.col("prev_output_id").alias("output_id"), F.col("tx_id").alias("spending_tx_id")), "output_id").distinct()


@query("jon_13", "SELECT tx_id, 'source' AS role, prev_output_id AS output_id, amount FROM tx_input UNION ALL SELECT tx_id, 'dest', id, amount FROM tx_output")
def jon_13(d):
    sources = d.tx_input.join(d.tx_output.select(F.col("id").alias("prev_output_id")), "prev_output_id", "left_semi").select("tx_id", F.lit("source").alias("role"), F.col("prev_output_id").alias("output_id"), "amount")
    return sources.unionByName(d.tx_output.select("tx_id", F.lit("dest").alias("role"), F.col("id").alias("output_id"), "amount"))


@query("jon_14", "SELECT i.tx_id, i.prev_output_id AS source_id, o.id AS dest_id FROM tx_input i JOIN tx_output o ON o.tx_id = i.tx_id AND o.output_index = i.input_index WHERE i.id % 5 <> 0 AND o.id % 3 <> 0")
def jon_14(d):
    """Asked links join input n to output n of a transaction; some name an output of no transaction, some a source it does not spend."""
    o = d.tx_output.select("tx_id", F.col("output_index").alias("input_index"), F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).alias("dest_id"))
    asked = d.tx_input.select("tx_id", "input_index", F.when(F.col("id") % 5 == 0, -F.col("id")).otherwise(F.col("prev_output_id")).alias("source_id")).join(o, ["tx_id", "input_index"])
    return asked.join(d.tx_output.select("tx_id", F.col("id").alias("dest_id")), ["tx_id", "dest_id"], "left_semi").join(d.tx_input.select("tx_id", F.col("prev_output_id").alias("source_id")), ["tx_id", "source_id"], "left_semi").select("tx_id", "source_id", "dest_id")


@query("jon_15", """SELECT a.id AS source_id, b.id AS dest_id, a.chain AS source_chain, b.chain AS dest_chain FROM movement a JOIN movement b ON b.tx_id = a.tx_id + a.tx_id % 2 + 1 AND b.id % 100 = a.id % 100 WHERE a.chain <> b.chain""")
def jon_15(d):
    """Asked links join the lines of a transaction to those of the one after it, or of the one after that, which is of the same chain."""
    v = m.movement_view(d.transfer, d.tx_output)
    a = v.select(F.col("id").alias("source_id"), (F.col("tx_id") + F.col("tx_id") % 2 + 1).alias("tx"), (F.col("id") % 100).alias("line"))
    b = v.select(F.col("id").alias("dest_id"), F.col("tx_id").alias("tx"), (F.col("id") % 100).alias("line"))
    return t.bridge_links(a.join(b, ["tx", "line"]).select("source_id", "dest_id"), v)


@query("agg_31", "SELECT kind, asset, n FROM (SELECT kind, asset, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, asset) AS place FROM transfer GROUP BY kind, asset) WHERE place = 1")
def agg_31(d):
    n = d.transfer.groupBy("kind", "asset").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("kind").agg(F.min_by("asset", F.struct(-F.col("n"), "asset")).alias("asset"), F.max("n").alias("n"))


@query("agg_32", "SELECT chain, max(block_height + tx_id % 9) AS tip FROM tx GROUP BY chain")
def agg_32(d):
    return d.tx.groupBy("chain").agg(F.max(F.col("block_height") + F.col("tx_id") % 9).alias("tip"))


@query("top_04", """WITH own AS (SELECT *, CASE WHEN dst = 's7' THEN CASE WHEN id % 5 <> 0 THEN src END WHEN src = 's7' THEN dst ELSE dst END AS other FROM transfer),
  n AS (SELECT other FROM own WHERE other IS NOT NULL GROUP BY other ORDER BY count(*) DESC, other LIMIT 10) SELECT id FROM own WHERE other IS NULL OR other IN (SELECT other FROM n)""")
def top_04(d):
    """Some transfers to the address have no sender."""
    rows = d.transfer.withColumn("src", F.when((F.col("dst") == "s7") & (F.col("id") % 5 == 0), F.lit(None)).otherwise(F.col("src")))
    return m.top_counterparties(rows, "s7", 10).select("id")
