"""Queries of merges, lifecycle and set operators; a table's rows are written in two or more batches of a split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as m
from ..operators.activity import activity_timeline
from ..operators.movements import merge_transfers
from ..scratch import new_folder
from ..streaming.ingest import ingest, stored
from .registry import Registry

REGISTRY = query = Registry()


@query("ups_01", """WITH r AS (SELECT event_type AS chain, k % 20 AS contract, CASE WHEN event_id % 3 <> 0 THEN 'S' || event_id % 11 END AS symbol, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 18 END AS decimals, event_id AS seq FROM ev)
  SELECT chain, contract, arg_max(symbol, seq) FILTER (WHERE symbol IS NOT NULL) AS symbol, coalesce(arg_min(decimals, seq) FILTER (WHERE decimals > 0), 0) AS decimals FROM r GROUP BY chain, contract""")
def ups_01(d):
    e = F.col("event_id")
    return m.upsert_assets(d.events.select(F.col("event_type").alias("chain"), (F.col("k") % 20).alias("contract"), F.when(e % 3 != 0, F.concat(F.lit("S"), e % 11)).alias("symbol"), F.when(e % 4 == 0, 0).otherwise(e % 18).alias("decimals"), e.alias("seq")))


@query("ups_02", """SELECT event_type AS chain, user_id AS address, arg_max('d' || event_id, event_id) AS display, arg_min(us, event_id) FILTER (WHERE event_id % 3 = 0) AS first_seen FROM ev GROUP BY 1, 2""")
def ups_02(d):
    e = F.col("event_id")
    return m.upsert_addresses(d.events.select(F.col("event_type").alias("chain"), F.col("user_id").alias("address"), F.concat(F.lit("d"), e).alias("display"), F.when(e % 3 == 0, F.col("us")).alias("first_seen"), e.alias("seq")))


@query("ups_03", """WITH r AS (SELECT event_type AS chain, user_id AS tx_hash, CASE WHEN event_id % 5 <> 0 THEN k END AS block_height, CASE WHEN event_id % 6 <> 0 THEN us END AS block_ts, CASE WHEN event_id % 2 = 0 THEN k END AS fee,
    CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN k < 5 THEN 'final' ELSE 'provisional' END AS finality, event_id % 3 = 0 AS authoritative, event_id % 4 <> 0 AS update_status, event_id AS seq FROM ev),
  f AS (SELECT *, row_number() OVER w AS n, coalesce(max(CASE WHEN finality = 'final' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frozen FROM r WINDOW w AS (PARTITION BY chain, tx_hash ORDER BY seq)),
  l AS (SELECT *, coalesce(max(seq) FILTER (WHERE authoritative) OVER (PARTITION BY chain, tx_hash), -1) AS base FROM f WHERE frozen = 0)
  SELECT chain, tx_hash, arg_max(block_height, seq) FILTER (WHERE seq >= base AND block_height IS NOT NULL) AS block_height, arg_max(block_ts, seq) FILTER (WHERE seq >= base AND block_ts IS NOT NULL) AS block_ts,
    arg_max(fee, seq) FILTER (WHERE fee IS NOT NULL) AS fee, arg_max(status, seq) FILTER (WHERE n = 1 OR update_status) AS status, arg_max(finality, seq) AS finality, max(seq) AS query_id FROM l GROUP BY chain, tx_hash""")
def ups_03(d):
    e, k = F.col("event_id"), F.col("k")
    return m.upsert_transactions(d.events.select(
        F.col("event_type").alias("chain"), F.col("user_id").alias("tx_hash"), F.when(e % 5 != 0, k).alias("block_height"), F.when(e % 6 != 0, F.col("us")).alias("block_ts"), F.when(e % 2 == 0, k).alias("fee"),
        F.when(e % 7 == 0, "failed").otherwise("success").alias("status"), F.when(k < 5, "final").otherwise("provisional").alias("finality"), (e % 3 == 0).alias("authoritative"), (e % 4 != 0).alias("update_status"), e.alias("seq"), e.alias("query_id"),
    ))


def _first(name, columns, keys, table="events", order="event_id"):
    """Registers an insert-once merge over a table, keyed by expressions that both SQL dialects read alike."""
    named = ", ".join(f"{k} AS key{i}" for i, k in enumerate(keys))

    @query(name, f"SELECT {named}, min(event_id) AS id FROM ev GROUP BY {', '.join(keys)}")
    def run(d):
        rows = d.events.select(*(F.expr(k).alias(f"key{i}") for i, k in enumerate(keys)), F.col("event_id").alias("id"))
        half = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
        cols = [f"key{i}" for i in range(len(keys))]
        return m.first_rows(half[0].unionByName(half[1]).unionByName(half[1]), cols, "id")

    run.__doc__ = columns
    return run


ups_07 = _first("ups_07", "Approvals by (chain, owner, spender, asset, transaction).", ["event_type", "user_id", "k", "CASE WHEN k > 50 THEN k % 3 END"])
ups_08 = _first("ups_08", "Attributions by content.", ["user_id", "event_type", "k % 5", "CASE WHEN k % 7 <> 0 THEN k % 3 END"])
ups_09 = _first("ups_09", "Risk claims by content, score and scale.", ["user_id", "CASE WHEN k % 4 <> 0 THEN k END", "event_type"])
ups_10 = _first("ups_10", "Risk sub-signals by (parent, signal).", ["user_id * 100 + k", "event_type"])
ups_12 = _first("ups_12", "Memberships by (entity, address, source, method).", ["k % 9", "user_id", "event_type", "k % 2"])


@query("ups_04", """SELECT tx_id, kind, src, dst, asset, amount // 1000000 AS amount, row_number() OVER (PARTITION BY tx_id, kind, src, dst, asset, amount // 1000000 ORDER BY id) - 1 AS occurrence, id, 2 AS writers FROM transfer""")
def ups_04(d):
    """A second source reports every transfer again under another id. Amounts are in units of 10,000 dollars, so that equal movements occur."""
    own = d.transfer.withColumn("amount", F.expr("amount div 1000000"))
    content = ["tx_id", "kind", "src", "dst", "asset", "amount"]
    both = own.withColumn("source", F.lit("first")).unionByName(own.withColumns({"id": F.col("id") + 10**12, "source": F.lit("second")}))
    return merge_transfers(both, content)


@query("ups_05", "SELECT tx_id, output_index, (id % 3 = 0 OR id % 5 = 0) AS spent, CASE WHEN id % 3 = 0 THEN id ELSE CASE WHEN id % 5 = 0 THEN -id END END AS spending_tx_id FROM tx_output")
def ups_05(d):
    i = F.col("id")
    base = d.tx_output.select("tx_id", "output_index", "id")
    batch = lambda n, spender, seq: base.select("tx_id", "output_index", (i % n == 0).alias("spent"), F.when(i % n == 0, spender).alias("spending_tx_id"), F.lit(seq).alias("seq"))
    return m.upsert_outputs(batch(3, i, 1).unionByName(batch(5, -i, 2)))


@query("ups_06", "SELECT tx_id, input_index, CASE WHEN id % 2 = 0 THEN prev_output_id ELSE -1 END AS prev_output_id, address FROM tx_input")
def ups_06(d):
    rows = d.tx_input
    old = rows.select("tx_id", "input_index", F.lit(-1).cast("long").alias("prev_output_id"), "address", F.lit(1).alias("seq"))
    new = rows.filter("id % 2 = 0").select("tx_id", "input_index", "prev_output_id", "address", F.lit(2).alias("seq"))
    return m.upsert_inputs(old.unionByName(new))


@query("ups_11", "SELECT id, value_e4 FROM valued UNION ALL SELECT id, value_e4 FROM valued WHERE id % 2 = 0")
def ups_11(d):
    rows = d.valued.select("id", "value_e4")
    return m.append(rows, rows.filter("id % 2 = 0"))


@query("ups_13", """WITH r AS (SELECT 'x' || user_id AS external_id, CASE WHEN event_id % 3 = 0 THEN 'Name ' || event_id ELSE 'x' || user_id END AS name, CASE WHEN event_id % 4 = 0 THEN event_type END AS kind, event_id AS seq FROM ev)
  SELECT external_id, coalesce(arg_min(name, seq) FILTER (WHERE name <> external_id), external_id) AS name, arg_min(kind, seq) FILTER (WHERE kind IS NOT NULL) AS kind FROM r GROUP BY external_id""")
def ups_13(d):
    e, x = F.col("event_id"), F.concat(F.lit("x"), "user_id")
    return m.upsert_entities(d.events.select(x.alias("external_id"), F.when(e % 3 == 0, F.concat(F.lit("Name "), e)).otherwise(x).alias("name"), F.when(e % 4 == 0, F.col("event_type")).alias("kind"), e.alias("seq")))


@query("ups_14", """SELECT id, tx_id FROM transfer UNION ALL SELECT min(id) + 1000000000000, tx_id FROM transfer t WHERE NOT EXISTS (SELECT 1 FROM transfer a WHERE a.tx_id = t.tx_id AND a.id % 3 <> 0) GROUP BY tx_id""")
def ups_14(d):
    rows = d.transfer.select("id", "tx_id")
    return m.insert_unless_active(rows, rows.filter("id % 3 = 0"), rows.withColumn("id", F.col("id") + 10**12), ["tx_id"])


@query("ups_15", """SELECT c_custkey + 5000 AS address_id, label, source, category FROM attribution a JOIN customer ON address = 'c' || c_custkey WHERE c_custkey % 2 = 0 AND NOT (c_custkey % 3 = 0 AND source = 'region')""")
def ups_15(d):
    k = F.col("c_custkey")
    ids = d.read("customer").select(k.alias("id"), F.lit("ethereum").alias("chain"), F.concat(F.lit("c"), k).alias("address"))
    claims = d.attribution.join(ids.select(F.col("id").alias("address_id"), "address"), "address").select("address_id", "label", "source", "category")
    target = ids.filter("id % 2 = 0").withColumn("id", F.col("id") + 5000)
    existing = claims.filter("address_id % 3 = 0 and source = 'region'").withColumn("address_id", F.col("address_id") + 5000)
    return m.copy_claims(claims, ids, target, existing, ["address_id", "label", "source", "category"]).select("address_id", "label", "source", "category")


@query("ups_16", "SELECT asset, price_ts, CASE WHEN price_ts // 86400 % 2 = 0 THEN price_cents ELSE price_cents + 1 END AS price_cents FROM price")
def ups_16(d):
    cached = d.price.filter("price_ts div 86400 % 2 = 0")
    return m.insert_missing(cached, d.price.withColumn("price_cents", F.col("price_cents") + 1), ["asset", "price_ts"])


@query("ups_17", "SELECT id, connector FROM source_query WHERE id % 3 <> 1")
def ups_17(d):
    q = d.source_query.select("id", "connector")
    return m.insert_missing(q.filter("id % 3 = 0"), q.filter("id % 3 <> 1"), ["id"])


@query("lif_01", """WITH tip AS (SELECT chain, max(block_height) AS tip, CASE chain WHEN 'bitcoin' THEN 6 ELSE 64 END AS threshold FROM tx GROUP BY chain)
  SELECT tx_id, CASE WHEN tx_id % 5 = 0 THEN -1 ELSE coalesce(greatest(0, tip - block_height + 1), 0) END AS confirmations,
    CASE WHEN tx_id % 5 = 0 OR coalesce(greatest(0, tip - block_height + 1), 0) >= threshold THEN 'final' ELSE 'provisional' END AS finality FROM tx JOIN tip USING (chain)""")
def lif_01(d):
    from ..functions.scalars import finality_threshold

    tips = d.tx.groupBy("chain").agg(F.max("block_height").alias("tip")).withColumn("threshold", finality_threshold(F.col("chain")))
    rows = d.tx.withColumn("finality", F.when(F.col("tx_id") % 5 == 0, "final").otherwise("provisional")).withColumn("confirmations", F.lit(-1).cast("long"))
    return m.upgrade_finality(rows, tips).select("tx_id", "confirmations", "finality")


_touched = "SELECT tx_id FROM transfer WHERE src = 's7' OR dst = 's7' UNION SELECT tx_id FROM tx_input WHERE address = 's7' UNION SELECT tx_id FROM tx_output WHERE address = 's7'"


def _touching(d):
    return m.touching(d.transfer, d.tx_input, d.tx_output, F.lit("s7"))


@query("set_01", _touched)
def set_01(d):
    return _touching(d)


@query("lif_02", f"SELECT tx_id, tx_id % 14 = 0 AS kept FROM ({_touched}) WHERE tx_id % 3 <> 0 AND tx_id % 4 <> 0")
def lif_02(d):
    tx = d.tx.withColumn("finality", F.when(F.col("tx_id") % 3 == 0, "final").otherwise("provisional"))
    return m.sweep_reorged(tx, _touching(d), d.tx.filter("tx_id % 4 = 0"), d.tx.filter("tx_id % 14 = 0"))


@query("lif_03", "SELECT tx_id FROM tx WHERE tx_id % 14 = 0 OR tx_id IN (SELECT tx_id FROM transfer WHERE id % 1000 = 7)")
def lif_03(d):
    """Notes on transactions, and tags on their movements."""
    refs = d.tx.filter("tx_id % 14 = 0").select("tx_id").unionByName(d.transfer.filter("id % 1000 = 7").select("tx_id"))
    return d.tx.join(refs, "tx_id", "left_semi").select("tx_id")


_targets = "f AS (SELECT event_id AS id, event_type IN ('click', 'view', 'purchase') AND k IN (SELECT DISTINCT k % 60 FROM ev) AS accepted, event_type = 'error' AS gone, event_id // 10 AS finding FROM ev)"


@query("lif_05", f"WITH {_targets} SELECT id, accepted FROM f")
def lif_05(d):
    """Rows on customers: the type must be allowed and the target exist."""
    return m.judge(_investigator_rows(d), ["click", "view", "purchase"], d.events.select((F.col("k") % 60).alias("target")).distinct()).select("id", "accepted")


def _investigator_rows(d):
    return d.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("k").alias("target"), F.expr("event_id div 10").alias("finding"))


@query("lif_05_cascade", f"WITH {_targets} SELECT id FROM f WHERE accepted AND finding NOT IN (SELECT finding FROM f WHERE gone)")
def lif_05_cascade(d):
    """Findings with a row of type error are deleted; their notes and references go with them."""
    rows = _investigator_rows(d)
    kept = m.judge(rows, ["click", "view", "purchase"], d.events.select((F.col("k") % 60).alias("target")).distinct()).filter("accepted")
    return m.drop_findings(kept, rows.filter("kind = 'error'").select("finding")).select("id")


@query("set_02", """SELECT us AS ts, 'fetch' AS kind, 'Fetched ' || event_type || ' · cap' || event_id % 4 || CASE WHEN event_id % 10 = 0 THEN ' · partial' ELSE '' END AS summary, 'source_query' AS ref_type, CAST(event_id AS VARCHAR) AS ref_id, props AS detail FROM ev
  UNION ALL SELECT us, 'trace', 'Trace created: t' || k, 'trace', CAST(event_id AS VARCHAR), NULL FROM ev WHERE event_type = 'signup' AND event_id % 7 <> 0
  UNION ALL SELECT us, 'finding', 'Finding recorded', 'finding', CAST(event_id AS VARCHAR), CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN rpad('', 79, 'y') || '…' ELSE props END FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT us, 'annotation', 'Annotation added to ' || CASE WHEN k % 2 = 0 THEN 'address' ELSE 'trace' END, 'annotation', CAST(event_id AS VARCHAR), NULL FROM ev WHERE event_type = 'click'
  UNION ALL SELECT us, 'tag', 'Tag ' || chr(39) || 'label' || k % 5 || chr(39) || ' added to entity', 'tag', CAST(event_id AS VARCHAR), NULL FROM ev WHERE event_type = 'view'
  UNION ALL SELECT us, CASE k % 3 WHEN 2 THEN 'bridge_link' ELSE 'trace_edit' END, CASE k % 3 WHEN 0 THEN 'Trace transfer link retracted' WHEN 1 THEN 'Trace BTC link retracted' ELSE 'Cross-chain bridge link added' END,
    CASE k % 3 WHEN 0 THEN 'trace_transfer_retraction' WHEN 1 THEN 'trace_btc_link_retraction' ELSE 'trace_bridge_link' END, CAST(event_id AS VARCHAR), NULL FROM ev WHERE event_type = 'error'
  UNION ALL SELECT block_ts * 1000000, 'exhibit', 'Exhibit captured (' || chain || ')', 'exhibit', CAST(tx_id AS VARCHAR), status FROM tx UNION ALL SELECT us, 'report', 'Report generated: r' || k, 'report', CAST(event_id AS VARCHAR), NULL FROM ev WHERE event_type = 'purchase'""")
def set_02(d):
    col = F.col
    of = lambda kind, *more: d.events.filter(col("event_type") == kind).select(col("event_id").alias("id"), col("us").alias("created_at"), "k", "props", *more)
    errors = of("error")
    return activity_timeline({
        "source_query": d.source_query.withColumn("endpoint", col("params")),
        "trace": of("signup", F.concat(F.lit("t"), "k").alias("name")), "trace_retraction": of("signup").filter("id % 7 = 0").select(col("id").alias("trace_id")),
        "finding": of("purchase", F.when(col("k") % 3 == 0, "  ").when(col("k") % 3 == 1, F.repeat(F.lit("y"), F.lit(90))).otherwise(F.concat(F.lit(" "), "props")).alias("statement")),
        "annotation": of("click", F.when(col("k") % 2 == 0, "address").otherwise("trace").alias("target_type")), "tag": of("view", F.concat(F.lit("label"), col("k") % 5).alias("label"), F.lit("entity").alias("target_type")),
        "trace_transfer_retraction": errors.filter("k % 3 = 0"), "trace_btc_link_retraction": errors.filter("k % 3 = 1"), "trace_bridge_link": errors.filter("k % 3 = 2"),
        "exhibit": d.tx.select(col("tx_id").alias("id"), col("chain").alias("exhibit_type"), (col("block_ts") * 1_000_000).alias("captured_at"), col("status").alias("description")),
        "report": of("purchase", F.concat(F.lit("r"), "k").alias("title")).withColumnRenamed("created_at", "generated_at"),
    })


@query("set_04", """SELECT tx_id, CASE WHEN tx_id % 6 = 0 THEN 'new' WHEN tx_id % 4 = 0 THEN 'finalized' ELSE 'corrected' END AS change FROM tx
  WHERE tx_id % 6 = 0 OR tx_id % 4 = 0 OR (tx_id % 9 = 1 AND block_height IS NOT NULL)""")
def set_04(d):
    k = F.col("tx_id")
    old = d.tx.filter("tx_id % 6 <> 0").withColumn("finality", F.lit("provisional"))
    new = d.tx.withColumn("finality", F.when(k % 4 == 0, "final").otherwise("provisional")).withColumn("block_height", F.when(k % 9 == 1, F.col("block_height") + 1).otherwise(F.col("block_height")))
    return m.refetch_diff(old, new, "tx_id", F.xxhash64("block_height", "status"))


@query("set_05", "SELECT tx_id AS hash FROM tx WHERE tx_id % 5 = 0 UNION SELECT tx_id FROM transfer WHERE tx_id % 5 = 0 UNION SELECT tx_id FROM tx_output WHERE tx_id % 5 = 0")
def set_05(d):
    final = d.tx.filter("tx_id % 5 = 0").select("tx_id")
    parts = [x.select("tx_id").join(final, "tx_id", "left_semi") for x in (d.tx, d.transfer, d.tx_output)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().select(F.col("tx_id").alias("hash"))


@query("str_01", """SELECT event_type, user_id, event_id, us, props FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, user_id, k % 10 ORDER BY event_id) = 1""")
def str_01(d):
    """All events land in three batches, one of which lands a second time; each row is known by (type, user, tens of k), the first one stays."""
    home, schema = new_folder(d.spark, "ingest"), "event_type string, user_id long, ten long, event_id long, us long, props string"
    rows = d.events.select("event_type", "user_id", (F.col("k") % 10).alias("ten"), "event_id", "us", "props")
    for nth, third in enumerate((2, 0, 1, 0)):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == third).write.parquet(f"{home}/landing/{nth}")
        ingest(d.spark, f"{home}/landing/*", schema, f"{home}/target", f"{home}/checkpoint", ["event_type", "user_id", "ten"], lambda r: m.first_rows(r, ["event_type", "user_id", "ten"], "event_id"), buckets=16, source="parquet")
    return stored(d.spark, f"{home}/target", schema).select("event_type", "user_id", "event_id", "us", "props")
