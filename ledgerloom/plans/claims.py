"""Queries of run lists, notes, evidence flags, entities and enrichment over claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as m
from ..operators import rosters as r
from ..operators.graph import entity_roster
from .registry import Registry

REGISTRY = query = Registry()


@query("agg_07", "SELECT dst AS hub, kind AS bucket, count(DISTINCT src) AS counterparties, count(*) AS edges FROM transfer WHERE kind <> 'payment' GROUP BY dst, kind")
def agg_07(d):
    folded = d.transfer.filter("kind <> 'payment'")
    return folded.groupBy(F.col("dst").alias("hub"), F.col("kind").alias("bucket")).agg(F.countDistinct("src").alias("counterparties"), F.count(F.lit(1)).alias("edges"))


@query("agg_13", "SELECT q.id, count(c.id) AS total, count(c.id) FILTER (WHERE c.id % 3 <> 0) AS active FROM source_query q LEFT JOIN claim c ON c.id // 2 = q.id WHERE connector IN ('click', 'view') GROUP BY q.id")
def agg_13(d):
    """Memberships of two runs each, every third retracted."""
    rows = d.claim.select(F.expr("id div 2").alias("run"), "id")
    gone = rows.filter("id % 3 = 0").select("id").withColumn("gone", F.lit(True))
    n = rows.join(gone, "id", "left").groupBy(F.col("run").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("gone").isNull()).alias("active"))
    runs = d.source_query.filter(F.col("connector").isin("click", "view")).select("id")
    return runs.join(n, "id", "left").select("id", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("active", F.lit(0)).cast("long").alias("active"))


@query("agg_25", """WITH n AS (SELECT subject, array_to_string(list_sort(list(label || id)), ',') AS notes FROM claim WHERE source = 'click' GROUP BY 1), t AS (SELECT subject, array_to_string(list_sort(list(DISTINCT category)), ',') AS tags FROM claim WHERE source = 'view' AND category IS NOT NULL GROUP BY 1),
  l AS (SELECT subject, label FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY retrieved_at DESC, id DESC) AS n FROM claim WHERE id % 5 = 0) WHERE n = 1)
  SELECT subject, notes, tags, label FROM n FULL JOIN t USING (subject) FULL JOIN l USING (subject)""")
def agg_25(d):
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    notes = d.claim.filter("source = 'click'").groupBy("subject").agg(joined(F.collect_list(F.concat("label", F.col("id").cast("string")))).alias("notes"))
    tags = d.claim.filter("source = 'view' and category is not null").groupBy("subject").agg(joined(F.collect_set("category")).alias("tags"))
    label = d.claim.filter("id % 5 = 0").groupBy("subject").agg(F.max_by("label", F.struct("retrieved_at", "id")).alias("label"))
    return notes.join(tags, "subject", "full_outer").join(label, "subject", "full_outer")


@query("agg_27", """SELECT 'UTXO' AS term, count(*) FILTER (WHERE chain = 'bitcoin') > 0 AS listed FROM tx UNION ALL SELECT 'FIFO', count(*) > 0 FROM tx_input UNION ALL SELECT 'provisional', count(*) FILTER (WHERE finality = 'provisional') > 0 FROM edge
  UNION ALL SELECT 'value at time', count(*) FILTER (WHERE value_e4 IS NOT NULL) > 0 FROM valued UNION ALL SELECT 'attribution', count(*) > 0 FROM attribution UNION ALL SELECT 'CoinJoin', (SELECT count(*) FROM (SELECT tx_id FROM tx_output GROUP BY tx_id HAVING count(*) >= 100)) > 0
  UNION ALL SELECT 'sanctioned', count(*) FILTER (WHERE category = 'sanctioned') > 0 FROM risk UNION ALL SELECT 'co-spend cluster', (SELECT count(*) FROM (SELECT tx_id FROM tx_input GROUP BY tx_id HAVING count(DISTINCT address) >= 2)) > 0 UNION ALL SELECT 'bridge', (SELECT count(*) FROM ev WHERE event_type = 'bridge') > 0""")
def agg_27(d):
    """FIFO links exist where inputs do; transactions of 100 outputs or more would stand for mixes here, events of type bridge for crossings."""
    shared = d.tx_input.groupBy("tx_id").agg(F.countDistinct("address").alias("n")).filter("n >= 2")
    return r.glossary({
        "UTXO": d.tx.filter("chain = 'bitcoin'"), "FIFO": d.tx_input, "provisional": d.edge.filter("finality = 'provisional'"), "value at time": d.valued.filter("value_e4 is not null"), "attribution": d.attribution,
        "CoinJoin": d.tx_output.groupBy("tx_id").count().filter("count >= 100"), "sanctioned": d.risk.filter("category = 'sanctioned'"), "co-spend cluster": shared, "bridge": d.events.filter("event_type = 'bridge'"),
    })


_named = "e AS (SELECT category AS entity, address, label, source FROM attribution WHERE CAST(substr(address, 2) AS BIGINT) % 9 <> 0)"


@query("agg_28", f"WITH {_named} SELECT entity, CASE WHEN count(DISTINCT source) > 1 THEN 'contested' ELSE 'resolved' END AS status, arg_min(label, source || '|' || label) AS name, count(DISTINCT address) AS members FROM e GROUP BY entity")
def agg_28(d):
    rows = _entities(d)
    return rows.groupBy("entity").agg(F.when(F.countDistinct("source") > 1, "contested").otherwise("resolved").alias("status"), F.min_by("label", F.concat_ws("|", "source", "label")).alias("name"), F.countDistinct("address").alias("members"))


def _entities(d):
    return d.attribution.filter(F.substring("address", 2, 20).cast("long") % 9 != 0).select(F.col("category").alias("entity"), "address", "label", "source")


@query("agg_29", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 5 THEN c_custkey - 1 END AS merged_into, c_mktsegment AS name FROM customer), m AS (SELECT 'c' || user_id AS member, CAST(k AS BIGINT) AS entity, event_id AS id FROM ev WHERE event_id % 3 <> 0),
  t AS (SELECT m.*, coalesce(p.merged_into, p.id) AS terminal FROM m JOIN p ON p.id = m.entity) SELECT terminal AS entity, min(p.name) AS name, count(DISTINCT member) AS members FROM t JOIN p ON p.id = terminal GROUP BY terminal""")
def agg_29(d):
    """Events assign users to entities, every third is retracted; the roster has canonical entities with an active member, merged ones under their terminal."""
    k = F.col("c_custkey")
    entities = d.read("customer").select(k.alias("id"), F.when(k % 10 == 5, k - 1).alias("merged_into"), F.col("c_mktsegment").alias("name"))
    rows = d.events.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), "user_id").alias("member"), F.col("k").alias("entity"))
    return entity_roster(entities, rows, rows.filter("id % 3 = 0").select("id"))


@query("agg_30", f"WITH {_named} SELECT entity, source, count(*) AS members, array_to_string(list_slice(list_sort(list(address)), 1, 5), ',') AS first, greatest(count(*) - 5, 0) AS more FROM e GROUP BY entity, source")
def agg_30(d):
    """Only the first five addresses of a group are gathered; the others are counted."""
    from pyspark.sql import Window as W

    rows = _entities(d)
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("entity", "source").orderBy("address"))).filter("n <= 5").groupBy("entity", "source").agg(F.array_join(F.array_sort(F.collect_list("address")), ",").alias("first"))
    n = rows.groupBy("entity", "source").agg(F.count(F.lit(1)).alias("members"))
    return n.join(first, ["entity", "source"]).select("entity", "source", "members", "first", F.greatest(F.col("members") - 5, F.lit(0)).cast("long").alias("more"))


@query("agg_33", "SELECT subject AS finding, array_to_string(list_sort(list(source || ' ' || label)), '; ') AS refs FROM claim GROUP BY subject")
def agg_33(d):
    return d.claim.groupBy(F.col("subject").alias("finding")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "label"))), "; ").alias("refs"))


@query("enr_01", "SELECT DISTINCT r.address, r.category, r.source FROM risk r JOIN attribution a ON a.address = r.address WHERE r.category = 'sanctioned'")
def enr_01(d):
    """Sanctioned addresses of the case only, each claim once."""
    known = d.risk.filter("category = 'sanctioned'").join(d.attribution.select("address").distinct(), "address", "left_semi")
    return m.first_rows(known.withColumn("seq", F.lit(1)), ["address", "category", "source"]).select("address", "category", "source")


@query("enr_02", "SELECT address, min(label) AS label, source FROM attribution WHERE category <> 'place' GROUP BY address, source")
def enr_02(d):
    return m.first_rows(d.attribution.filter("category <> 'place'").withColumn("seq", F.col("label")), ["address", "source"]).select("address", "label", "source")


@query("enr_09", "SELECT r.source, count(*) AS claims FROM risk r WHERE r.address IN (SELECT address FROM attribution) GROUP BY r.source")
def enr_09(d):
    return d.risk.join(d.attribution.select("address").distinct(), "address", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("claims"))


@query("enr_11", "SELECT c.id, q.connector, q.capability, e.k FROM claim c JOIN source_query q ON q.id = c.id JOIN ev e ON e.event_id = c.id")
def enr_11(d):
    q = d.source_query.select("id", "connector", "capability", F.get_json_object("params", "$.k").cast("long").alias("k"))
    return d.claim.select("id").join(q, "id")


@query("aud_08", """SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 IN (3, 4)""")
def aud_08(d):
    """Entities whose merge pointers form a cycle."""
    from ..operators.clustering import resolve_merges

    k = F.col("c_custkey")
    to = F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).otherwise(F.expr("c_custkey - c_custkey % 10"))
    return resolve_merges(d.read("customer").filter("c_custkey % 10 <> 0").select(k.alias("id"), to.alias("merged_into"))).filter("cyclic").select("id")
