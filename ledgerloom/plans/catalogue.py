"""Audits and cascades over the declared catalogue, on all tables of a case that the given data project to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as c
from ..operators import movements as m
from ..operators.tracing import fifo_intervals
from ..scratch import table
from .registry import Registry

REGISTRY = query = Registry()

#: Which query a row cites: some cite none, some one that is not there.
_q = lambda n: f"CASE WHEN {n} % 101 = 0 THEN NULL WHEN {n} % 103 = 0 THEN -1 ELSE {n} % 50 END"
_num = "CAST(regexp_extract({}, '[0-9]+') AS BIGINT)"
_AT = "DISTINCT address FROM (SELECT src AS address FROM transfer UNION ALL SELECT dst FROM transfer UNION ALL SELECT address FROM tx_output UNION ALL SELECT address FROM attribution)"

#: The tables of a case in SQL, columns by position as in _case.
_case_sql = f"""c_asset AS (SELECT asset AS id, 'ethereum' AS chain, asset AS contract, {_q("n")} AS q FROM asset),
  c_address AS (SELECT address AS id, 'any' AS chain, address, {_q(_num.format("address"))} AS q FROM (SELECT {_AT}) WHERE {_num.format("address")} % 97 <> 0),
  c_tx AS (SELECT tx_id AS id, chain, CASE WHEN tx_id % 89 = 0 THEN 1 ELSE tx_id END AS tx_hash, {_q("tx_id")} AS q FROM tx),
  c_transfer AS (SELECT id, tx_id AS transaction_id, kind, src, dst, asset, amount, {_q("id")} AS q FROM transfer),
  c_output AS (SELECT o.id, o.tx_id AS transaction_id, address, output_index, i.tx_id AS spending_tx_id, i.tx_id IS NOT NULL AS spent, {_q("o.id")} AS q FROM tx_output o LEFT JOIN (SELECT prev_output_id, min(tx_id) AS tx_id FROM tx_input GROUP BY 1) i ON prev_output_id = o.id),
  c_input AS (SELECT id, tx_id AS transaction_id, address, prev_output_id, input_index, {_q("id")} AS q FROM tx_input),
  c_attribution AS (SELECT address || '/' || source AS id, address, CASE WHEN {_num.format("address")} % 3 = 0 THEN 'investigator' ELSE source END AS source, {_q(_num.format("address"))} AS q FROM attribution),
  c_risk AS (SELECT address || '/' || category AS id, address, {_q(_num.format("address"))} AS q FROM risk),
  c_detail AS (SELECT id || '/d' AS id, id AS risk_assessment_id, 'signal' AS signal, q FROM c_risk UNION ALL SELECT id || '/e', id || 'x', 'signal', q FROM c_risk WHERE q % 7 = 0),
  c_valuation AS (SELECT id, CASE WHEN id % 19 = 0 THEN 'tx_output' ELSE 'transfer' END AS subject_type, id AS subject_id, {_q("id")} AS q FROM valued WHERE value_e4 IS NOT NULL UNION ALL SELECT -id, 'tx_output', id, {_q("id")} FROM tx_output),
  c_member AS (SELECT address AS id, label AS entity_id, address, {_q(_num.format("address"))} AS q FROM attribution WHERE source = 'segment'),
  c_ref AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'address' WHEN 1 THEN 'transaction' WHEN 2 THEN 'transfer' WHEN 3 THEN 'tx_output' ELSE 'planet' END AS kind,
    CASE event_id % 5 WHEN 0 THEN 'c' || user_id WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id * 100 + 1 AS VARCHAR) END AS target FROM ev)"""


def _cited(n):
    return F.when(n % 101 == 0, F.lit(None)).when(n % 103 == 0, F.lit(-1)).otherwise(n % 50).cast("long").alias("source_query_id")


def _digits(name):
    return F.regexp_extract(name, "[0-9]+", 0).cast("long")


def _case(d):
    """The tables of a case by name. Some rows cite no query, some addresses are not listed, some references lead nowhere.

    Movements and valuations are projected once and kept as tables, as nearly all others read them.
    """
    col, id_ = F.col, F.col("id")
    d.transfer, d.tx_output = table(d.transfer, "case-transfers"), table(d.tx_output, "case-outputs")
    d.tx_input = table(d.tx_input, "case-inputs")
    names = d.transfer.select(F.col("src").alias("address")).unionByName(d.transfer.select(F.col("dst").alias("address"))).unionByName(d.tx_output.select("address")).unionByName(d.attribution.select("address")).distinct()
    outputs = m.resolve_spends(d.tx_input, d.tx_output)[1]
    risk = d.risk.select(F.concat_ws("/", "address", "category").alias("id"), col("address").alias("address_id"), _cited(_digits("address")))
    detail = risk.select(F.concat("id", F.lit("/d")).alias("id"), col("id").alias("risk_assessment_id"), F.lit("signal").alias("signal"), "source_query_id")
    segment = d.attribution.filter("source = 'segment'")
    turn = col("event_id") % 5
    refs = d.events.select(
        col("event_id").alias("id"), F.when(turn == 0, "address").when(turn == 1, "transaction").when(turn == 2, "transfer").when(turn == 3, "tx_output").otherwise("planet").alias("kind"),
        F.when(turn == 0, F.concat(F.lit("c"), "user_id")).when(turn == 1, col("event_id").cast("string")).otherwise((col("event_id") * 100 + 1).cast("string")).alias("target"),
    )
    valued = d.valued.filter("value_e4 is not null").select("id", F.when(id_ % 19 == 0, "tx_output").otherwise("transfer").alias("subject_type"), id_.alias("subject_id"), _cited(id_))
    return {
        "source_query": d.source_query.select("id"),
        "asset": d.asset.select(col("asset").alias("id"), F.lit("ethereum").alias("chain"), col("asset").alias("contract"), _cited(col("n"))),
        "address": names.filter(_digits("address") % 97 != 0).select(col("address").alias("id"), F.lit("any").alias("chain"), "address", _cited(_digits("address"))),
        "transaction_": d.tx.select(col("tx_id").alias("id"), "chain", F.when(col("tx_id") % 89 == 0, 1).otherwise(col("tx_id")).alias("tx_hash"), _cited(col("tx_id"))),
        "transfer": m.occurrences(d.transfer, ["tx_id", "kind", "src", "dst", "asset", "amount"], ["id"]).select("id", col("tx_id").alias("transaction_id"), col("kind").alias("transfer_type"), col("src").alias("from_address_id"), col("dst").alias("to_address_id"), col("asset").alias("asset_id"), "amount", "occurrence", _cited(id_)),
        "tx_output": outputs.select("id", col("tx_id").alias("transaction_id"), col("address").alias("address_id"), "output_index", "spending_tx_id", "spent", _cited(id_)),
        "tx_input": d.tx_input.select("id", col("tx_id").alias("transaction_id"), col("address").alias("address_id"), "prev_output_id", "input_index", _cited(id_)),
        "attribution": d.attribution.select(F.concat_ws("/", "address", "source").alias("id"), col("address").alias("address_id"), F.when(_digits("address") % 3 == 0, "investigator").otherwise(col("source")).alias("source"), _cited(_digits("address"))),
        "risk_assessment": risk,
        "risk_detail": detail.unionByName(risk.filter("source_query_id % 7 = 0").select(F.concat("id", F.lit("/e")).alias("id"), F.concat("id", F.lit("x")).alias("risk_assessment_id"), F.lit("signal").alias("signal"), "source_query_id")),
        "valuation": table(valued.unionByName(d.tx_output.select((-id_).alias("id"), F.lit("tx_output").alias("subject_type"), id_.alias("subject_id"), _cited(id_))), "case-valuations"),
        "balance_snapshot": names.select(F.concat(F.lit("b"), "address").alias("id"), col("address").alias("address_id"), _cited(_digits("address"))),
        "entity": segment.select(col("label").alias("id"), F.lit(None).cast("string").alias("merged_into")).distinct(),
        "entity_membership": segment.select(col("address").alias("id"), col("label").alias("entity_id"), col("address").alias("address_id"), F.lit("segment").alias("source"), _cited(_digits("address"))),
        "entity_membership_retraction": segment.filter(_digits("address") % 4 == 0).select(F.concat(F.lit("r"), "address").alias("id"), F.when(_digits("address") % 8 == 0, "nobody").otherwise(col("address")).alias("membership_id"), F.lit("investigator").alias("source"), _cited(_digits("address"))),
        "finding_ref": refs.select("id", F.lit(None).cast("string").alias("finding_id"), col("kind").alias("ref_type"), col("target").alias("ref_id")),
        "annotation": refs.select("id", col("kind").alias("target_type"), col("target").alias("target_id")),
    }


_members = f"SELECT 'r' || address AS id, CASE WHEN {_num.format('address')} % 8 = 0 THEN 'nobody' ELSE address END AS membership_id, {_q(_num.format('address'))} AS q FROM attribution WHERE source = 'segment' AND {_num.format('address')} % 4 = 0"
_CITING = [("asset", "c_asset", "false"), ("address", "c_address", "false"), ("transaction_", "c_tx", "false"), ("transfer", "c_transfer", "false"), ("tx_output", "c_output", "false"), ("tx_input", "c_input", "false"), ("attribution", "c_attribution", "source = 'investigator'"), ("risk_assessment", "c_risk", "false"), ("risk_detail", "c_detail", "false"), ("valuation", "c_valuation", "false"), ("balance_snapshot", f"(SELECT 'b' || address AS id, {_q(_num.format('address'))} AS q FROM (SELECT {_AT}))", "false"), ("entity_membership", "c_member", "false"), ("entity_membership_retraction", f"({_members})", "true")]
_cites = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", CAST(id AS VARCHAR) AS id, q, {free} AS free FROM {rows}" for n, rows, free in _CITING)


@query("aud_01", f"""WITH {_case_sql}, cited AS ({_cites})
  SELECT "table", id, CASE WHEN q IS NULL THEN 'missing' ELSE 'unresolvable' END AS reason FROM cited WHERE (q IS NULL AND NOT free) OR q NOT IN (SELECT event_id FROM ev)""")
def aud_01(d):
    """All thirteen tables whose rows cite a query."""
    return c.unproven(_case(d))


_REFS = [("transfer", "transaction_id", "c_transfer", "transaction_id", "c_tx", "true"), ("transfer", "from_address_id", "c_transfer", "src", "c_address", "true"), ("transfer", "to_address_id", "c_transfer", "dst", "c_address", "true"), ("transfer", "asset_id", "c_transfer", "asset", "c_asset", "true"), ("tx_output", "transaction_id", "c_output", "transaction_id", "c_tx", "true"), ("tx_output", "address_id", "c_output", "address", "c_address", "true"), ("tx_output", "spending_tx_id", "c_output", "spending_tx_id", "c_tx", "true"), ("tx_input", "transaction_id", "c_input", "transaction_id", "c_tx", "true"), ("tx_input", "address_id", "c_input", "address", "c_address", "true"), ("tx_input", "prev_output_id", "c_input", "prev_output_id", "c_output", "true"), ("attribution", "address_id", "c_attribution", "address", "c_address", "true"), ("risk_assessment", "address_id", "c_risk", "address", "c_address", "true"), ("risk_detail", "risk_assessment_id", "c_detail", "risk_assessment_id", "c_risk", "true"), ("valuation", "subject_id", "c_valuation", "subject_id", "c_transfer", "subject_type = 'transfer'"), ("valuation", "subject_id", "c_valuation", "subject_id", "c_output", "subject_type = 'tx_output'"), ("balance_snapshot", "address_id", f"(SELECT 'b' || address AS id, address FROM (SELECT {_AT}))", "address", "c_address", "true"), ("entity_membership", "entity_id", "c_member", "entity_id", "(SELECT entity_id AS id FROM c_member)", "true"), ("entity_membership", "address_id", "c_member", "address", "c_address", "true"), ("entity_membership_retraction", "membership_id", f"({_members})", "membership_id", "c_member", "true"), *((t, col, "c_ref", "target", rows, f"kind = '{kind}'") for t, col in (("finding_ref", "ref_id"), ("annotation", "target_id")) for kind, rows in (("address", "c_address"), ("transaction", "c_tx"), ("transfer", "c_transfer"), ("tx_output", "c_output"), ("planet", "(SELECT 1 AS id WHERE false)")))]
_lost = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{ref}' AS reference, CAST(x.id AS VARCHAR) AS id, CAST(x.{col} AS VARCHAR) AS target FROM {rows} x WHERE x.{col} IS NOT NULL AND {when} AND CAST(x.{col} AS VARCHAR) NOT IN (SELECT CAST(id AS VARCHAR) FROM {to})" for t, ref, rows, col, to, when in _REFS)


@query("aud_03", f"WITH {_case_sql} {_lost}")
def aud_03(d):
    """Every declared reference of the case's tables, the polymorphic ones by kind; 'planet' is no declared kind."""
    return c.dangling(_case(d))


_KEYS = [("asset", "c_asset", "chain, contract"), ("address", "c_address", "chain, address"), ("transaction_", "c_tx", "chain, tx_hash"), ("transfer", "c_transfer", "id"), ("tx_output", "c_output", "transaction_id, output_index"), ("tx_input", "c_input", "transaction_id, input_index"), ("risk_detail", "c_detail", "risk_assessment_id, signal")]


@query("aud_04_tables", f"WITH {_case_sql} " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT ({key})) AS keys, count(*) = count(DISTINCT ({key})) AS ok FROM {rows}" for t, rows, key in _KEYS))
def aud_04_tables(d):
    """Some transactions share a hash; the occurrence makes every transfer's key its own."""
    return c.natural_keys(_case(d))


@query("lif_04", f"""WITH {_case_sql}, gone AS (SELECT id FROM c_tx WHERE id % 5 = 0), gone_t AS (SELECT id FROM c_transfer WHERE transaction_id IN (SELECT id FROM gone)), gone_o AS (SELECT id FROM c_output WHERE transaction_id IN (SELECT id FROM gone)),
  a AS (SELECT tx_id, prev_output_id AS source_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY input_index) AS hi FROM tx_input), b AS (SELECT tx_id, id AS dest_id, amount, sum(amount) OVER (PARTITION BY tx_id ORDER BY output_index) AS hi FROM tx_output),
  link AS (SELECT a.tx_id, source_id, dest_id FROM a JOIN b ON a.tx_id = b.tx_id AND a.hi - a.amount < b.hi AND b.hi - b.amount < a.hi AND a.amount > 0 AND b.amount > 0)
  SELECT 'transaction_' AS "table", CAST(id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS link FROM c_tx WHERE id % 5 <> 0 UNION ALL SELECT 'transfer', CAST(id AS VARCHAR), NULL FROM c_transfer WHERE transaction_id % 5 <> 0
  UNION ALL SELECT 'tx_output', CAST(id AS VARCHAR), CASE WHEN spending_tx_id % 5 <> 0 THEN spending_tx_id END FROM c_output WHERE transaction_id % 5 <> 0
  UNION ALL SELECT 'tx_input', CAST(id AS VARCHAR), CASE WHEN prev_output_id NOT IN (SELECT id FROM gone_o) THEN prev_output_id END FROM c_input WHERE transaction_id % 5 <> 0
  UNION ALL SELECT 'valuation', CAST(id AS VARCHAR), NULL FROM c_valuation WHERE NOT (subject_type = 'transfer' AND subject_id IN (SELECT id FROM gone_t)) AND NOT (subject_type = 'tx_output' AND subject_id IN (SELECT id FROM gone_o))
  UNION ALL SELECT 'trace_transfer', 'e' || id, NULL FROM c_transfer WHERE transaction_id % 5 <> 0 AND id % 3 = 0
  UNION ALL SELECT 'trace_btc_link', source_id || '-' || dest_id, NULL FROM link WHERE tx_id % 5 <> 0 AND source_id NOT IN (SELECT id FROM gone_o) AND dest_id NOT IN (SELECT id FROM gone_o)""")
def lif_04(d):
    """Every fifth transaction goes, with its movements, their valuations and the traces over them; spends of it are undone."""
    col, all_ = F.col, _case(d)
    tables = {name: all_[name] for name in ("transaction_", "transfer", "tx_output", "tx_input", "valuation")}
    links = fifo_intervals(d.tx_input.select("tx_id", col("prev_output_id").alias("id"), "input_index", "amount"), d.tx_output)
    links = table(links.select("tx_id", "source_id", "dest_id"), "case-links")
    tables["trace_transfer"] = d.transfer.filter("id % 3 = 0").select(F.concat(F.lit("e"), col("id").cast("string")).alias("id"), F.lit("t").alias("trace_id"), col("id").alias("transfer_id"))
    tables["trace_btc_link"] = links.select(F.concat_ws("-", "source_id", "dest_id").alias("id"), F.lit("t").alias("trace_id"), col("tx_id").alias("transaction_id"), col("source_id").alias("source_output_id"), col("dest_id").alias("dest_output_id"))
    left = c.cascade(tables, {"transaction_": d.tx.filter("tx_id % 5 = 0").select(col("tx_id").alias("id"))})
    link = {"tx_output": "spending_tx_id", "tx_input": "prev_output_id"}
    rows = [t.select(F.lit(name).alias("table"), col("id").cast("string").alias("id"), (col(link[name]) if name in link else F.lit(None)).cast("long").alias("link")) for name, t in left.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
