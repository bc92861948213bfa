"""Queries of rosters, disagreements, graph views and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import lookalike_key, row_hash
from ..operators import merkle
from ..operators import movements as m
from ..operators import rosters as r
from .registry import Registry

REGISTRY = query = Registry()

_last = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, source ORDER BY retrieved_at DESC, id DESC) AS n FROM claim) WHERE n = 1)"


@query("win_04", f"WITH {_last} SELECT subject, source, id, label, category, retrieved_at FROM last")
def win_04(d):
    return r.latest_per_source(d.claim)


@query("win_05", "SELECT subject, label FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY retrieved_at DESC, id DESC) AS n FROM claim) WHERE n = 1")
def win_05(d):
    return d.claim.groupBy("subject").agg(F.max_by("label", F.struct("retrieved_at", "id")).alias("label"))


@query("win_06", "SELECT id, 'Exhibit ' || row_number() OVER (PARTITION BY connector ORDER BY requested_at, id) AS exhibit FROM source_query")
def win_06(d):
    rows = r.numbered(d.source_query.select("connector", "requested_at", "id"), ["requested_at", "id"], within=["connector"])
    return rows.select("id", F.concat(F.lit("Exhibit "), "place").alias("exhibit"))


@query("win_12", "SELECT connector, max(id) AS anchor FROM source_query GROUP BY connector")
def win_12(d):
    return d.source_query.groupBy("connector").agg(F.max("id").alias("anchor"))


@query("agg_20", f"""WITH {_last} SELECT subject, count(DISTINCT source) AS sources, count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) > 1 AS label_differs,
  count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) > 1 AS category_differs FROM last GROUP BY subject HAVING sources >= 2 AND (label_differs OR category_differs)""")
def agg_20(d):
    return r.disagreements(d.claim, ["label", "category"])


@query("agg_21", f"""WITH {_last} SELECT subject, count(DISTINCT source) AS sources, count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) > 1 AS category_differs FROM last GROUP BY subject HAVING sources >= 2 AND category_differs""")
def agg_21(d):
    return r.disagreements(d.claim, ["category"])


@query("agg_22", """SELECT id AS subject, 2 AS sources, true AS value_differs FROM valued WHERE value_e4 IS NOT NULL AND id % 4 = 0 AND id % 3 <> 0""")
def agg_22(d):
    """A second source repeats the value where the id is divisible by 3 and is off by one elsewhere."""
    v = d.valued.filter("value_e4 is not null")
    claim = lambda rows, source, value: rows.select(F.col("id").alias("subject"), "id", F.lit(source).alias("source"), value.cast("decimal(38,4)").alias("value"), F.lit(1).alias("retrieved_at"))
    both = claim(v, "feed", F.col("value_e4")).unionByName(claim(v.filter("id % 4 = 0"), "export", F.col("value_e4") + F.when(F.col("id") % 3 == 0, 0).otherwise(1)))
    return r.disagreements(both, ["value"])


@query("agg_03", """WITH a AS (SELECT address, max(CASE WHEN category = 'sanctioned' THEN 'sanctioned' ELSE 'elevated' END) AS risk, array_to_string(list_sort(list(DISTINCT source)), ',') AS risk_sources FROM risk GROUP BY 1),
  b AS (SELECT address, array_to_string(list_sort(list(DISTINCT source)), ',') AS attribution_sources FROM attribution GROUP BY 1) SELECT address, risk, risk_sources, attribution_sources FROM a FULL JOIN b USING (address)""")
def agg_03(d):
    return r.address_flags(d.risk, d.attribution)


@query("agg_04", """WITH e AS (SELECT source AS other, 'in' AS way, value_e4 FROM edge WHERE target = 's10' UNION ALL SELECT target, 'out', value_e4 FROM edge WHERE source = 's10')
  SELECT other, coalesce(sum(value_e4) FILTER (WHERE way = 'in'), 0)::BIGINT AS value_in, coalesce(sum(value_e4) FILTER (WHERE way = 'out'), 0)::BIGINT AS value_out, count(*) FILTER (WHERE way = 'in') AS n_in, count(*) FILTER (WHERE way = 'out') AS n_out
  FROM e GROUP BY other ORDER BY value_in + value_out DESC, n_in + n_out DESC, other LIMIT 50""")
def agg_04(d):
    return r.counterparties(d.edge, F.lit("s10"), 50)


_dust = "CASE WHEN value_e4 IS NOT NULL THEN value_e4 < 300000000 ELSE amount < 1000000 END"
_ends = f"e AS (SELECT target AS hub, 'in' AS direction, source AS other, value_e4, asset FROM edge WHERE {_dust} UNION ALL SELECT source, 'out', target, value_e4, asset FROM edge WHERE {_dust})"


@query("agg_05", f"WITH {_ends} SELECT hub, direction, count(DISTINCT other) AS counterparties, coalesce(sum(value_e4), 0)::BIGINT AS value_e4, count(*) FILTER (WHERE value_e4 IS NULL) AS no_price FROM e GROUP BY hub, direction")
def agg_05(d):
    return r.dust_buckets(d.edge, F.expr(_dust))


@query("agg_06", f"WITH {_ends} SELECT hub, direction, asset, count(DISTINCT other) AS counterparties, coalesce(sum(value_e4), 0)::BIGINT AS value_e4, count(*) FILTER (WHERE value_e4 IS NULL) AS no_price FROM e GROUP BY hub, direction, asset")
def agg_06(d):
    return r.dust_buckets(d.edge, F.expr(_dust), by_asset=True)


@query("agg_08", f"SELECT count(*) FILTER (WHERE {_dust}) AS dust, count(*) FILTER (WHERE value_e4 IS NULL) AS unpriced, count(*) FILTER (WHERE annotated) AS annotated FROM edge")
def agg_08(d):
    return d.edge.agg(F.count_if(F.expr(_dust)).alias("dust"), F.count_if(F.col("value_e4").isNull()).alias("unpriced"), F.count_if("annotated").alias("annotated"))


@query("agg_09", "SELECT target AS focus, asset, amount // 100000 AS denomination, count(DISTINCT source) AS counterparties FROM edge GROUP BY 1, 2, 3 HAVING count(DISTINCT source) >= 2")
def agg_09(d):
    return d.edge.groupBy(F.col("target").alias("focus"), "asset", F.expr("amount div 100000").alias("denomination")).agg(F.countDistinct("source").alias("counterparties")).filter("counterparties >= 2")


@query("agg_14", "SELECT count(*) AS total, count(*) FILTER (WHERE value_e4 IS NOT NULL) AS valued, count(*) FILTER (WHERE value_e4 IS NULL) AS missing, count(*) FILTER (WHERE value_e4 IS NOT NULL AND id % 4 = 0) AS contested FROM valued")
def agg_14(d):
    claims = d.valued.filter("value_e4 is not null").select("id").unionByName(d.valued.filter("value_e4 is not null and id % 4 = 0").select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = d.valued.select("id").join(claims, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n").isNotNull()).alias("valued"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("contested"))


@query("agg_15", "SELECT event_id AS query_id, event_type AS connector, (SELECT count(*) FROM transfer t WHERE t.tx_id = event_id) + (SELECT count(*) FROM tx_output o WHERE o.tx_id = event_id) AS n FROM ev")
def agg_15(d):
    return r.produced_by_query([d.transfer.withColumn("query_id", F.col("tx_id")), d.tx_output.withColumn("query_id", F.col("tx_id"))], d.source_query)


@query("agg_16", "SELECT event_id AS query_id, event_type AS connector, count(c.id) AS n FROM ev LEFT JOIN claim c ON c.id = event_id GROUP BY 1, 2")
def agg_16(d):
    return r.produced_by_query([d.claim.withColumn("query_id", F.col("id"))], d.source_query)


@query("agg_17", "SELECT address, bool_or(category = 'sanctioned') AS sanctioned, count(*) AS claims, array_to_string(list_sort(list(category || ' by ' || source)), '; ') AS roster FROM risk GROUP BY address")
def agg_17(d):
    line = F.concat_ws(" by ", "category", "source")
    return d.risk.groupBy("address").agg(F.bool_or(F.col("category") == "sanctioned").alias("sanctioned"), F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("roster"))


@query("agg_18", "SELECT address, source, count(*) AS claims, array_to_string(list_sort(list(label)), ';') AS labels FROM attribution GROUP BY address, source")
def agg_18(d):
    return d.attribution.groupBy("address", "source").agg(F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_list("label")), ";").alias("labels"))


@query("agg_19", """WITH v AS (SELECT id, value_e4 AS value, 'feed' AS source FROM valued WHERE value_e4 IS NOT NULL UNION ALL SELECT id, value_e4 + id % 7 - 3, CASE WHEN id % 8 = 0 THEN 'feed' ELSE 'export' END FROM valued WHERE value_e4 IS NOT NULL AND id % 4 < 2)
  SELECT id AS movement, source, count(*) AS claims, min(value) AS least, max(value) AS most, count(DISTINCT source) OVER (PARTITION BY id) > 1 AS contested FROM v GROUP BY id, source""".replace("count(DISTINCT source) OVER (PARTITION BY id) > 1", "count(*) OVER (PARTITION BY id) > 1"))
def agg_19(d):
    """Valuations of every movement by source; a movement that more than one source values is contested, two claims of one source are not."""
    v = d.valued.filter("value_e4 is not null").select("id", F.col("value_e4").alias("value"))
    more = v.filter("id % 4 < 2").select("id", (F.col("value") + F.col("id") % 7 - 3).alias("value"), F.when(F.col("id") % 8 == 0, "feed").otherwise("export").alias("source"))
    return r.valuations_by_source(v.withColumn("source", F.lit("feed")).unionByName(more))


@query("agg_23", "SELECT cust AS trace, count(*) FILTER (WHERE id % 7 <> 0) AS edges, sum(amount) FILTER (WHERE id % 7 <> 0)::BIGINT AS amount FROM pay GROUP BY cust")
def agg_23(d):
    return _traced(d.payments)


def _traced(payments):
    from ..operators.tracing import effective

    rows = payments.select(F.col("cust").alias("trace"), "id", "amount")
    kept = effective(rows, rows.filter("id % 7 = 0"), "id").groupBy("trace").agg(F.count(F.lit(1)).alias("edges"), F.sum("amount").alias("amount"))
    return rows.select("trace").distinct().join(kept, "trace", "left").select("trace", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "amount")


@query("agg_24", "SELECT array_to_string(list_sort(list(DISTINCT chain)), ',') AS chains, count(*) AS transactions, (SELECT count(*) FROM (SELECT src FROM transfer UNION SELECT dst FROM transfer UNION SELECT address FROM tx_output)) AS addresses FROM tx")
def agg_24(d):
    a = d.transfer.select(F.explode(F.array("src", "dst")).alias("address")).unionByName(d.tx_output.select("address")).agg(F.countDistinct("address").alias("addresses"))
    return d.tx.agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"), F.count(F.lit(1)).alias("transactions")).join(F.broadcast(a))


@query("agg_26", "SELECT DISTINCT chain, CASE chain WHEN 'bitcoin' THEN 6 ELSE 64 END AS threshold FROM tx")
def agg_26(d):
    from ..functions.scalars import finality_threshold

    return d.tx.select("chain").distinct().withColumn("threshold", finality_threshold(F.col("chain")))


@query("top_01", """WITH top AS (SELECT node FROM (SELECT source AS node FROM edge UNION ALL SELECT target FROM edge) GROUP BY node ORDER BY count(*) DESC, node LIMIT 150)
  SELECT id FROM edge WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)""")
def top_01(d):
    return r.top_subgraph(d.edge, 150).select("id")


@query("top_03", "SELECT connector, arg_min('c' || k, requested_at) AS seed FROM source_query JOIN (SELECT event_id AS id, k FROM ev) USING (id) JOIN customer ON c_custkey = k GROUP BY connector")
def top_03(d):
    seeds = d.source_query.withColumn("k", F.get_json_object("params", "$.k").cast("long")).join(d.read("customer").select(F.col("c_custkey").alias("k")), "k", "left_semi")
    return seeds.groupBy("connector").agg(F.min_by(F.concat(F.lit("c"), "k"), F.struct("requested_at", "id")).alias("seed"))


@query("top_05", "SELECT hub, other, place <= 50 AS revealed FROM (SELECT target AS hub, source AS other, row_number() OVER (PARTITION BY target ORDER BY sum(amount) DESC, source) AS place FROM edge GROUP BY 1, 2)")
def top_05(d):
    return r.revealed(d.edge, 50)


_hexed = "SELECT id, CASE WHEN kind = 'lookalike' THEN '0x' || lpad(hex(CAST(substr(src, 2) AS BIGINT) % 97), 4, '0') || lpad('', 32, 'f') || '00cc' ELSE '0x' || lpad(hex(CAST(substr(src, 2) AS BIGINT) % 97), 4, '0') || lpad(substr(src, 2), 32, '0') || '00cc' END AS src, dst, amount FROM transfer"


@query("grf_23", f"""WITH t AS ({_hexed}), a AS (SELECT address, max(amount) AS most FROM (SELECT src AS address, amount FROM t UNION ALL SELECT dst, amount FROM t) GROUP BY 1),
  hit AS (SELECT z.id, z.src AS lookalike, p.src AS mimics FROM t z JOIN a ON a.address = z.src AND most = 0 JOIN t p ON p.dst = z.dst AND p.amount > 0 AND lower(left(p.src, 6)) = lower(left(z.src, 6)) AND right(p.src, 4) = right(z.src, 4) AND p.src <> z.src WHERE z.amount = 0)
  SELECT id, lookalike, min(mimics) AS mimics FROM hit GROUP BY id, lookalike""")
def grf_23(d):
    n = F.substring("src", 2, 20)
    first = F.lpad(F.hex(n.cast("long") % 97), 4, "0")
    middle = F.when(F.col("kind") == "lookalike", F.repeat(F.lit("f"), F.lit(32))).otherwise(F.lpad(n, 32, "0"))
    rows = d.transfer.select("id", F.concat(F.lit("0x"), first, middle, F.lit("00cc")).alias("src"), "dst", "amount")
    return r.poisoning(rows, lookalike_key(F.col("address")))


@query("jon_17", """WITH known AS (SELECT source AS chain, subject AS address FROM claim WHERE id % 3 <> 0), now AS (SELECT source AS chain, subject AS address FROM claim WHERE id % 3 = 0)
  SELECT edition, chain, address FROM (SELECT chain, address FROM known EXCEPT SELECT chain, address FROM now), (VALUES ('newest'), ('undated')) e(edition)""")
def jon_17(d):
    """Against the newest edition, one without a date, and one that is older than what was read before, which tells nothing."""
    rows = d.claim.select("id", F.col("source").alias("chain"), F.col("subject").alias("address"))
    editions = d.claim.select(F.when(F.col("id") % 2 == 0, F.lit("2024-05-01").cast("date")).alias("published"))
    parts = [r.delisted(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), editions, F.lit(day).cast("date")).withColumn("edition", F.lit(name)) for name, day in (("newest", "2024-05-01"), ("undated", None), ("stale", "2024-04-30"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_shown = "CASE WHEN length(x) > 9 THEN left(x, 4) || '…' || right(x, 4) ELSE x END"


@query("jon_18", f"""WITH ref AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'transaction' WHEN 2 THEN 'transfer' ELSE 'entity' END AS kind, CASE event_id % 4 WHEN 0 THEN 'c' || user_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '0xabcdef' || event_id ELSE 'e' || k END AS x FROM ev),
  a AS (SELECT address, min(label) AS label FROM attribution WHERE source = 'region' GROUP BY 1)
  SELECT event_id, kind, x AS id, CASE kind WHEN 'address' THEN coalesce(a.label, x) WHEN 'transaction' THEN coalesce(chain || ' ' || tx_id, x) WHEN 'transfer' THEN 'transfer ' || {_shown} ELSE 'entity ' || {_shown} END AS label,
    CASE kind WHEN 'address' THEN 'addr:' || x WHEN 'transaction' THEN 'tx:' || x END AS node FROM ref LEFT JOIN a ON kind = 'address' AND a.address = x LEFT JOIN tx ON kind = 'transaction' AND CAST(tx_id AS VARCHAR) = x""")
def jon_18(d):
    i, turn = F.col("event_id"), F.col("event_id") % 4
    kind = F.when(turn == 0, "address").when(turn == 1, "transaction").when(turn == 2, "transfer").otherwise("entity")
    ident = F.when(turn == 0, F.concat(F.lit("c"), "user_id")).when(turn == 1, i.cast("string")).when(turn == 2, F.concat(F.lit("0xabcdef"), i)).otherwise(F.concat(F.lit("e"), "k"))
    labels = {"address": d.attribution.filter("source = 'region'").select(F.col("address").alias("id"), "label"), "transaction": d.tx.select(F.col("tx_id").alias("id"), F.concat_ws(" ", "chain", "tx_id").alias("label"))}
    return r.display(d.events.select("event_id", kind.alias("kind"), ident.alias("id")), labels)


@query("jon_19", "SELECT id, owner IN (SELECT address FROM attribution) AND spender IN (SELECT dst FROM transfer UNION SELECT src FROM transfer) AS accepted FROM approval")
def jon_19(d):
    known = d.attribution.select(F.col("address").alias("owner")).distinct().withColumn("a", F.lit(True))
    moved = d.transfer.select(F.explode(F.array("src", "dst")).alias("spender")).distinct().withColumn("b", F.lit(True))
    return d.approval.join(known, "owner", "left").join(moved, "spender", "left").select("id", (F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))).alias("accepted"))


@query("jon_08", "SELECT address, label AS entity FROM attribution WHERE source = 'segment' AND CAST(substr(address, 2) AS BIGINT) % 9 <> 0")
def jon_08(d):
    from ..operators.tracing import effective

    members = d.attribution.filter("source = 'segment'").select("address", F.col("label").alias("entity"))
    return effective(members, members.filter(F.substring("address", 2, 20).cast("long") % 9 == 0), "address")


@query("aud_02", "SELECT id FROM claim WHERE id % 10 = 0")
def aud_02(d):
    return r.missing_keys(d.claim.withColumn("query_id", F.col("id")), "query_id", d.source_query.filter("status = 'ok'"), "id").select("id")


@query("aud_04", "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS ok FROM lineitem")
def aud_04(d):
    return r.duplicate_keys(d.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("aud_05", "SELECT id FROM movement WHERE subject_type = 'tx_output' AND id % 1000 = 101")
def aud_05(d):
    """A source is written to some outputs, as no ledger does."""
    rows = m.movement_view(d.transfer, d.tx_output).withColumn("src", F.when((F.col("subject_type") == "tx_output") & (F.col("id") % 1000 == 101), "made up").otherwise(F.col("src")))
    return rows.filter("subject_type = 'tx_output' and src is not null").select("id")


@query("aud_06", "SELECT id FROM valued WHERE id % 17 = 0")
def aud_06(d):
    claims = d.valued.select("id", F.when(F.col("id") % 17 == 0, "tx_output").otherwise("transfer").alias("subject_type"))
    return claims.join(m.movement_view(d.transfer, d.tx_output).select("subject_type", "id"), ["subject_type", "id"], "left_anti").select("id")


@query("aud_07", "SELECT event_id AS id FROM ev WHERE event_id % 4 < 2 AND event_id % 3 = 0")
def aud_07(d):
    params = F.when(F.col("id") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"bounds": '), "params", F.lit("}")))
    return d.source_query.filter(F.col("capability").isin("cap0", "cap1") & F.get_json_object(params, "$.bounds").isNull()).select("id")


@query("aud_09", "SELECT tx_id, CASE WHEN tx_id % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM tx WHERE tx_id % 5 = 0 AND (tx_id % 11 = 0 OR tx_id % 13 = 0)")
def aud_09(d):
    final = d.tx.filter("tx_id % 5 = 0")
    changed = final.filter("tx_id % 11 <> 0").withColumn("status", F.when(F.col("tx_id") % 13 == 0, "rewritten").otherwise(F.col("status")))
    hashed = lambda rows: rows.select("tx_id", row_hash("tx_id", "chain", "block_height", "block_ts", "status").alias("hash"))
    return r.snapshot_changes(hashed(final), hashed(changed), "tx_id")


@query("aud_10", "SELECT id, CASE WHEN id % 10 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM claim WHERE id % 10 = 0 OR id % 7 = 0")
def aud_10(d):
    new = d.claim.filter("id % 10 <> 0").withColumn("label", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("label")))
    hashed = lambda rows: rows.select("id", row_hash("id", "subject", "source", "label", "category", "retrieved_at").alias("hash"))
    return r.snapshot_changes(hashed(d.claim), hashed(new), "id")


@query("aud_11", "SELECT id, 'deleted' AS change FROM approval WHERE id % 3 = 0")
def aud_11(d):
    hashed = d.approval.select("id", row_hash("id", "owner", "spender").alias("hash"))
    return r.snapshot_changes(hashed, hashed.filter("id % 3 <> 0"), "id")


_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END"
_TX = ["tx_id", "chain", "block_height", "block_ts", "status"]
_tree = f"""counted AS (SELECT k, h, k || ' ' || h || ' ' || count(*) AS line, count(*) AS copies FROM (SELECT sha256({_field("tx_id")}) AS k, sha256({" || ".join(map(_field, _TX))}) AS h FROM tx) GROUP BY k, h),
  depth AS (SELECT min(d) AS depth FROM range(1, 12) r(d) WHERE pow(16, d) * 64 >= (SELECT count(*) FROM tx)),
  tree(level, position, digest, rows) AS (SELECT depth, substr(k, 1, depth), sha256(string_agg(line, chr(10) ORDER BY line)), sum(copies)::BIGINT FROM counted, depth GROUP BY 1, 2
    UNION ALL SELECT level - 1, substr(position, 1, level - 1), sha256(string_agg(position || ' ' || digest, chr(10) ORDER BY position)), sum(rows)::BIGINT FROM tree WHERE level > 0 GROUP BY 1, 2)"""


def _snapshot(rows, of):
    return merkle.snapshot(rows, ["tx_id"], _TX, merkle.depth_for(of.count()))


@query("aud_12", f"WITH {_tree} SELECT digest, rows FROM tree WHERE level = 0")
def aud_12(d):
    return _snapshot(d.tx, d.tx).anchor()


@query("aud_12_tree", f"WITH {_tree} SELECT level::INT AS level, position, digest, rows FROM tree")
def aud_12_tree(d):
    return _snapshot(d.tx, d.tx).tree()


@query("aud_09_tree", """SELECT tx_id, 'deleted' AS change FROM tx WHERE tx_id % 55 = 0 UNION ALL SELECT tx_id, 'modified' FROM tx WHERE tx_id % 65 = 0 AND tx_id % 55 <> 0
  UNION ALL SELECT -tx_id - 1, 'added' FROM tx WHERE tx_id % 97 = 0""")
def aud_09_tree(d):
    """Some transactions go, some are rewritten and some are new; found by descending both trees."""
    k = F.col("tx_id")
    now = d.tx.filter(k % 55 != 0).withColumn("status", F.when(k % 65 == 0, "rewritten").otherwise(F.col("status")))
    return merkle.changes(_snapshot(d.tx, d.tx), _snapshot(now.unionByName(d.tx.filter(k % 97 == 0).withColumn("tx_id", -k - 1)), d.tx))


@query("aud_13", """SELECT 'idempotency' AS check, false AS ok, count(*) AS offending, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT CAST(id AS VARCHAR) AS id FROM claim WHERE id % 10 = 0 ORDER BY 1 LIMIT 20)) AS sample FROM claim WHERE id % 10 = 0
  UNION ALL SELECT 'no-fabricated-edge', true, 0, ''""")
def aud_13(d):
    return r.run_audits({"idempotency": d.claim.filter("id % 10 = 0"), "no-fabricated-edge": d.tx_output.filter("address is null")})
