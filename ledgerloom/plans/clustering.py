"""Queries of clustering and graph resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as c
from ..operators.components import connected_components
from ..operators.movements import resolve_spends
from ..scratch import table
from .fixtures import WEI_SQL, wei
from .registry import Registry

REGISTRY = query = Registry()

def _components(edges, members="SELECT a AS node FROM e UNION SELECT b FROM e"):
    """SQL of components by the least label that reaches a node; a recursive table with one row for each node."""
    return f"""{edges}, both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), component(node, component) USING KEY (node) AS (SELECT node, node FROM ({members})
    UNION (SELECT u.node, min(v.component) FROM component v JOIN both_ways ON b = v.node JOIN recurring.component u ON u.node = a WHERE v.component < u.component GROUP BY u.node))"""


_cospend = _components("WITH o AS (SELECT DISTINCT tx_id, address FROM tx_output), e AS MATERIALIZED (SELECT DISTINCT m.a, s.address AS b FROM o s JOIN (SELECT tx_id, min(address) AS a FROM o GROUP BY 1) m USING (tx_id) WHERE a <> address)")


def _spent_together(rows):
    return connected_components(c.star_edges(rows.select("tx_id", "address").distinct(), "tx_id", "address"))


@query("grf_01", _cospend + " SELECT node, component FROM component")
def grf_01(d):
    return _spent_together(d.tx_output)


_mix = "(SELECT tx_id FROM tx_output GROUP BY tx_id HAVING count(*) >= 6)"


@query("grf_02", _cospend + f""" SELECT node AS address, component AS cluster, node IN (SELECT address FROM o WHERE tx_id IN {_mix}) AS flagged,
  CASE WHEN node IN (SELECT address FROM o WHERE tx_id IN {_mix}) THEN 0.5e0 ELSE 0.9e0 END AS confidence FROM component""")
def grf_02(d):
    """Transactions of six outputs or more stand for mixes here."""
    return c.cospend_clusters(d.tx_output, d.tx_output.groupBy("tx_id").count().filter("count >= 6").select("tx_id"))


def _named(suffix, rows):
    """The parts of _cospend under names of their own, over some transactions' inputs."""
    o = f"(SELECT DISTINCT tx_id, address FROM tx_input WHERE {rows})"
    return f"""e{suffix} AS MATERIALIZED (SELECT DISTINCT m.a, s.address AS b FROM {o} s JOIN (SELECT tx_id, min(address) AS a FROM {o} GROUP BY 1) m USING (tx_id) WHERE a <> address),
    both{suffix} AS MATERIALIZED (SELECT a, b FROM e{suffix} UNION SELECT b, a FROM e{suffix}), comp{suffix}(node, component) USING KEY (node) AS (SELECT node, node FROM (SELECT a AS node FROM e{suffix} UNION SELECT b FROM e{suffix})
    UNION (SELECT u.node, min(v.component) FROM comp{suffix} v JOIN both{suffix} ON b = v.node JOIN recurring.comp{suffix} u ON u.node = a WHERE v.component < u.component GROUP BY u.node))"""


@query("grf_02_batches", f"""WITH {_named(1, "tx_id % 4 = 1")}, {_named(2, "true")},
  mix AS (SELECT tx_id FROM (SELECT tx_id, max(n) AS same FROM (SELECT tx_id, amount // 2000000 AS v, count(*) AS n FROM tx_output GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT tx_id, count(*) AS inputs FROM tx_input GROUP BY 1) USING (tx_id) WHERE inputs >= 5 AND same >= 5),
  joined AS (SELECT c.node, c.component, sha256('run-1|' || f.component) AS old FROM comp2 c LEFT JOIN comp1 f USING (node)),
  survivor AS (SELECT component, coalesce(min(old), sha256('run-2|' || component)) AS entity_id FROM joined GROUP BY component),
  seen AS (SELECT DISTINCT address, tx_id % 4 = 1 AS early FROM tx_input WHERE tx_id IN (SELECT tx_id FROM mix))
  SELECT 'member' AS kind, node AS id, entity_id, EXISTS (SELECT 1 FROM seen WHERE seen.address = node AND early = (old IS NOT NULL)) AS flagged FROM joined JOIN survivor USING (component)
  UNION ALL SELECT DISTINCT 'merge', old, entity_id, false FROM joined JOIN survivor USING (component) WHERE old <> entity_id""")
def grf_02_batches(d):
    """Two batches of transactions one after the other: members with their resolved entities, and entities that the second batch merged."""
    mixes = c.coinjoins(d.tx_input, d.tx_output.withColumn("amount", F.expr("amount div 2000000")))
    none = d.tx_input.filter("false").select("address", F.lit("").alias("entity_id"))
    first, _ = c.cospend_batch(none, d.tx_input.filter("tx_id % 4 = 1"), mixes, "run-1")
    first = table(first, "memberships")
    second, merges = c.cospend_batch(first, d.tx_input.filter("tx_id % 4 <> 1"), mixes, "run-2")
    now = c.current_members(first.unionByName(second), merges)
    return now.select(F.lit("member").alias("kind"), F.col("address").alias("id"), "entity_id", "flagged").unionByName(merges.select(F.lit("merge").alias("kind"), "id", F.col("merged_into").alias("entity_id"), F.lit(False).alias("flagged")))


@query("agg_10", "SELECT tx_id, count(DISTINCT address) AS addresses, array_to_string(list_sort(list(DISTINCT address)), ',') AS members FROM tx_input GROUP BY tx_id")
def agg_10(d):
    members = F.array_sort(F.collect_set("address"))
    return d.tx_input.filter("address is not null").groupBy("tx_id").agg(F.size(members).cast("long").alias("addresses"), F.array_join(members, ",").alias("members"))


@query("agg_11", """WITH v AS (SELECT tx_id, amount // 2000000 AS amount, count(*) AS n FROM tx_output GROUP BY 1, 2), t AS (SELECT tx_id, max(n) AS same FROM v GROUP BY 1), i AS (SELECT tx_id, count(*) AS inputs FROM tx_input GROUP BY 1)
  SELECT tx_id FROM t JOIN i USING (tx_id) WHERE inputs >= 5 AND same >= 5""")
def agg_11(d):
    """Amounts are rounded down to 20,000 dollars, so that equal ones occur."""
    return c.coinjoins(d.tx_input, d.tx_output.withColumn("amount", F.expr("amount div 2000000")))


@query("grf_03", "SELECT 'h' || k AS address, count(DISTINCT event_type) AS chains FROM ev WHERE event_type <> 'error' GROUP BY k HAVING count(DISTINCT event_type) >= 2")
def grf_03(d):
    return _on_chains(d.events)


def _on_chains(events):
    chain = F.when(F.col("event_type") == "error", "bitcoin").otherwise(F.col("event_type"))
    return c.same_address(events.select(chain.alias("chain"), F.concat(F.lit("h"), "k").alias("address")))


@query("grf_04", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey - 1 ELSE c_custkey // 3 END AS merged_into FROM customer WHERE c_custkey > 0 AND c_custkey % 7 <> 0),
  walk(id, pos, n) AS (SELECT id, merged_into, 1 FROM p UNION ALL SELECT walk.id, p.merged_into, n + 1 FROM walk JOIN p ON p.id = pos WHERE n < 64)
  SELECT id, CASE WHEN max(n) = 64 THEN -1 ELSE arg_max(pos, n) END AS terminal, max(n) = 64 AS cyclic FROM walk GROUP BY id""")
def grf_04(d):
    k = F.col("c_custkey")
    to = F.when(k % 10 == 3, k + 1).when(k % 10 == 4, k - 1).otherwise(F.expr("c_custkey div 3"))
    done = c.resolve_merges(d.read("customer").filter("c_custkey > 0 and c_custkey % 7 <> 0").select(k.alias("id"), to.alias("merged_into")))
    return done.withColumn("terminal", F.when(F.col("cyclic"), F.lit(-1).cast("long")).otherwise(F.col("terminal")))


def _spent(d):
    return resolve_spends(d.tx_input, d.tx_output)[1]


@query("grf_06", "SELECT id FROM tx_output o WHERE EXISTS (SELECT 1 FROM tx_input i WHERE i.tx_id = o.tx_id AND i.address = o.address)")
def grf_06(d):
    return c.change_reuse(d.tx_input, d.tx_output).select("id")


@query("grf_07", """WITH k AS (SELECT tx_id, min(CAST(substr(address, 3) AS BIGINT) % 2) AS a, max(CAST(substr(address, 3) AS BIGINT) % 2) AS b FROM tx_input GROUP BY tx_id)
  SELECT o.id FROM tx_output o JOIN k USING (tx_id) WHERE a = b AND CAST(substr(address, 3) AS BIGINT) % 2 = a""")
def grf_07(d):
    """Odd addresses are script addresses here."""
    n = F.substring("address", 3, 20).cast("long")
    typed = lambda rows: rows.withColumn("address", F.concat(F.when(n % 2 == 0, "1P").otherwise("3P"), n))
    return c.change_type(typed(d.tx_input), typed(d.tx_output)).select("id")


@query("grf_08", "SELECT o.id FROM tx_output o JOIN (SELECT tx_id, min(amount) AS least, count(*) AS n FROM tx_input GROUP BY 1) USING (tx_id) WHERE n = 1 OR amount < least")
def grf_08(d):
    return c.change_optimal(d.tx_input, d.tx_output).select("id")


@query("grf_09", "SELECT id FROM tx_output WHERE amount % 100 <> 0")
def grf_09(d):
    return c.change_power_of_ten(d.tx_output, 2).select("id")


@query("grf_10", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY coalesce(block_height, 4611686018427387904), output_index, id) AS n FROM tx_output) WHERE n = 1")
def grf_10(d):
    return c.change_fresh(d.tx_output).select("id")


@query("grf_11", """WITH o AS (SELECT t.*, t.id IN (SELECT prev_output_id FROM tx_input) AND t.output_index = 0 AS spent FROM tx_output t)
  SELECT id FROM o WHERE spent AND tx_id IN (SELECT tx_id FROM o GROUP BY tx_id HAVING count(*) = 2 AND count(*) FILTER (WHERE spent) = 1)""")
def grf_11(d):
    return c.change_peeling(_spent(d).withColumn("spent", F.col("spent") & (F.col("output_index") == 0))).select("id")


_votes = """cand AS (
  SELECT tx_id, id, 'reuse' AS heuristic FROM tx_output o WHERE EXISTS (SELECT 1 FROM tx_input i WHERE i.tx_id = o.tx_id AND i.address = o.address)
  UNION ALL SELECT o.tx_id, o.id, 'optimal' FROM tx_output o JOIN (SELECT tx_id, min(amount) AS least, count(*) AS n FROM tx_input GROUP BY 1) USING (tx_id) WHERE n = 1 OR amount < least
  UNION ALL SELECT tx_id, id, 'fresh' FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY coalesce(block_height, 4611686018427387904), output_index, id) AS n FROM tx_output) WHERE n = 1
  UNION ALL SELECT tx_id, id, 'odd' FROM tx_output WHERE amount % 10 <> 0),
single AS (SELECT tx_id, heuristic, min(id) AS id FROM cand GROUP BY 1, 2 HAVING count(*) = 1)"""
_names = ["optimal", "reuse", "fresh", "odd"]


def _candidates(d):
    return c.candidates({"reuse": c.change_reuse(d.tx_input, d.tx_output), "optimal": c.change_optimal(d.tx_input, d.tx_output), "fresh": c.change_fresh(d.tx_output), "odd": c.change_power_of_ten(d.tx_output, 1)})


@query("grf_12", f"WITH {_votes} SELECT tx_id, heuristic, id FROM single")
def grf_12(d):
    return c.unique_candidates(_candidates(d)).select("tx_id", "heuristic", "id")


@query("set_03", f"""WITH {_votes}, v AS (SELECT tx_id, id, count(*) AS votes, bool_or(heuristic = 'optimal') AS first FROM cand GROUP BY 1, 2)
  SELECT 'and' AS how, tx_id, id, votes FROM v WHERE votes = 4 UNION ALL SELECT 'diff', tx_id, id, votes FROM v WHERE first AND votes = 1
  UNION ALL SELECT 'agree', tx_id, id, count(*) FROM single GROUP BY 2, 3 HAVING count(*) >= 2""")
def set_03(d):
    rows = _candidates(d)
    parts = [c.compose(rows, how, _names).select(F.lit(how).alias("how"), "tx_id", "id", "votes") for how in ("and", "diff", "agree")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("grf_13", _components(f"""WITH {_votes}, agree AS (SELECT tx_id, id, count(*) AS votes FROM single GROUP BY 1, 2 HAVING count(*) >= 2),
  change AS (SELECT a.tx_id, o.address, a.votes FROM (SELECT tx_id, min(id) AS id, max(votes) AS votes FROM agree GROUP BY 1 HAVING count(*) = 1) a JOIN tx_output o ON o.id = a.id),
  member AS (SELECT * FROM change UNION ALL SELECT DISTINCT i.tx_id, i.address, votes FROM tx_input i JOIN change USING (tx_id)),
  e AS (SELECT DISTINCT m.a, s.address AS b FROM member s JOIN (SELECT tx_id, min(address) AS a FROM member GROUP BY 1) m USING (tx_id) WHERE a <> address)""") + """
  SELECT node AS address, component AS cluster, CAST(round(least(0.85, 0.4 + 0.15 * max(votes)) * 1000) AS BIGINT) AS confidence_thousandths FROM component JOIN member ON address = node GROUP BY 1, 2""")
def grf_13(d):
    votes = c.compose(_candidates(d), "agree", _names)
    found = c.change_clusters(d.tx_input, d.tx_output, votes, d.tx.filter("false").select("tx_id"))
    return found.select("address", "cluster", F.round(F.col("confidence") * 1000).cast("long").alias("confidence_thousandths"))


_forward = """fw AS (SELECT DISTINCT i.dst AS deposit, i.src AS "user", o.dst AS exchange FROM transfer i JOIN transfer o ON o.src = i.dst AND o.asset = i.asset
  WHERE i.dst NOT IN (SELECT address FROM exchange) AND i.src NOT IN (SELECT address FROM exchange) AND o.dst IN (SELECT address FROM exchange) AND i.amount - o.amount BETWEEN 0 AND 1 AND o.block_height - i.block_height BETWEEN 0 AND 3200)"""


@query("jon_09", f"WITH {_forward} SELECT * FROM fw")
def jon_09(d):
    return c.deposit_forwards(d.transfer, d.exchange, F.lit(1)).distinct()


@query("jon_09_wei", f"""WITH w AS (SELECT *, CAST({WEI_SQL.format(amount='amount', id='id')} AS HUGEINT) AS wei FROM transfer)
  SELECT DISTINCT i.dst AS deposit, i.src AS "user", o.dst AS exchange FROM w i JOIN w o ON o.src = i.dst AND o.asset = i.asset
  WHERE i.dst NOT IN (SELECT address FROM exchange) AND i.src NOT IN (SELECT address FROM exchange) AND o.dst IN (SELECT address FROM exchange) AND i.wei - o.wei BETWEEN 0 AND 100000000000000000000000 AND o.block_height - i.block_height BETWEEN 0 AND 3200""")
def jon_09_wei(d):
    """Amounts in text, far beyond 64 bits; the tolerance too."""
    return c.deposit_forwards(d.transfer.withColumn("amount", wei()), d.exchange, F.lit("1" + "0" * 23)).distinct()


@query("grf_14", _components(f"""WITH {_forward}, u AS (SELECT DISTINCT deposit, "user" FROM fw WHERE deposit IN (SELECT deposit FROM fw GROUP BY 1 HAVING count(DISTINCT exchange) = 1)),
  e AS (SELECT DISTINCT m.a, u."user" AS b FROM u JOIN (SELECT deposit, min("user") AS a FROM u GROUP BY 1) m USING (deposit) WHERE a <> "user")""") + """,
  n AS (SELECT component, count(*) AS size FROM component GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1000)
  SELECT node AS address, component AS cluster, size, CASE WHEN size = 2 THEN 0.35e0 ELSE 0.6e0 END AS confidence, size = 2 AS masquerade_risk FROM component JOIN n USING (component)""")
def grf_14(d):
    return c.deposit_reuse(c.deposit_forwards(d.transfer, d.exchange, F.lit(1)))


_drop = "drops AS (SELECT DISTINCT 'c' || user_id AS recipient FROM ev WHERE event_type = 'signup'), sent AS (SELECT DISTINCT 'c' || user_id AS recipient, 'g' || user_id % 40 AS aggregator FROM ev WHERE event_type = 'purchase' AND k < 10), af AS (SELECT recipient, aggregator FROM drops JOIN sent USING (recipient))"


def _airdrop(d):
    who = F.concat(F.lit("c"), "user_id")
    cols = lambda src, dst: [src.alias("src"), dst.alias("dst"), F.lit("DROP").alias("asset"), F.lit(100).cast("long").alias("amount")]
    rows = d.events.filter("event_type = 'signup'").select(*cols(F.lit("a1"), who)).unionByName(d.events.filter("event_type = 'purchase' and k < 10").select(*cols(who, F.concat(F.lit("g"), F.col("user_id") % 40))))
    return c.airdrop_forwards(rows, d.exchange, 10)


@query("jon_10", f"WITH {_drop} SELECT * FROM af")
def jon_10(d):
    return _airdrop(d).select("recipient", "aggregator")


@query("grf_15", _components(f"WITH {_drop}, e AS (SELECT recipient AS a, aggregator AS b FROM af WHERE aggregator IN (SELECT aggregator FROM af GROUP BY 1 HAVING count(*) >= 2))") + " SELECT node AS address, component AS cluster, count(*) OVER (PARTITION BY component) AS size FROM component")
def grf_15(d):
    return c.airdrop_clusters(_airdrop(d))


_pairs = """pair AS (SELECT DISTINCT owner, spender FROM approval WHERE owner <> spender),
  ok AS (SELECT * FROM pair WHERE spender IN (SELECT spender FROM pair GROUP BY 1 HAVING count(*) <= 7) AND owner IN (SELECT owner FROM pair GROUP BY 1 HAVING count(*) <= 7) AND spender NOT IN (SELECT address FROM attribution WHERE category = 'exchange'))"""


def _approved(d):
    return c.approval_pairs(d.approval, d.attribution.filter("category = 'exchange'"), 7)


@query("jon_20", f"WITH {_pairs} SELECT * FROM ok")
def jon_20(d):
    return _approved(d)


@query("grf_16", _components(f"WITH {_pairs}, e AS (SELECT owner AS a, spender AS b FROM ok)") + " SELECT node AS address, component AS cluster, count(*) OVER (PARTITION BY component) AS size FROM component")
def grf_16(d):
    return c.sized(connected_components(_approved(d), "owner", "spender"))


@query("grf_17", _cospend + " SELECT node AS address, sha256('run-1|' || component) AS entity_id FROM component")
def grf_17(d):
    clusters = _spent_together(d.tx_output)
    return c.materialize(clusters.select(F.col("node").alias("address"), F.col("component").alias("cluster")), "run-1").select("address", "entity_id")


@query("grf_18", "SELECT event_id AS id FROM ev WHERE event_id % 9 = 0 OR event_type = 'signup'")
def grf_18(d):
    rows = d.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("run"))
    return c.undo(rows, rows.filter("id % 9 = 0"), "signup")


@query("agg_12", _cospend + " SELECT component AS cluster, count(*) OVER (PARTITION BY component) AS size, node AS address FROM component")
def agg_12(d):
    """Members are rows of their own; the size comes from an aggregate with map-side combine."""
    found = _spent_together(d.tx_output)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return found.join(sizes, "component").select(F.col("component").alias("cluster"), "size", F.col("node").alias("address"))
