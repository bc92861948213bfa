"""Queries of intelligence sources and enrichment: projected rows are serialised to payloads in the plan and normalised again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import usd_label
from ..operators import enrichment as e
from ..operators import rosters
from ..scratch import new_folder, shared_dir
from ..sources import intelligence as p
from ..sources.imports import write_import
from .registry import Registry

REGISTRY = query = Registry()

_CHAINS = {"ETH": "ethereum", "BTC": "bitcoin"}
_LEVELS = ["# levels", "", "id,level", "web_crawl,20", "heuristic,10", "ownership,100"]


def _text(name):
    return F.col(name).cast("string")


def _payload(rows):
    return rows.select(F.to_json(F.struct("*")).alias("payload"))


def _hex(n):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 40, "0"))


def _sql_hex(n):
    return f"'0x' || lpad(lower(hex({n})), 40, '0')"


def _internal(d):
    rows = d.payments.select(F.concat(F.lit("0x"), "tx_id").alias("hash"), _text("block_height").alias("blockNumber"), _text("block_ts").alias("timeStamp"), F.upper("src").alias("from"), F.upper("dst").alias("to"), F.when(F.col("id") % 10 == 0, "0").otherwise(_text("amount")).alias("value"), F.concat(F.lit("0_"), 100 - F.col("rn")).alias("traceId"), F.when(F.col("id") % 7 == 0, "1").otherwise("0").alias("isError"))
    return p.adapt_internal(_payload(rows))


@query("src_02", "SELECT tx_hash, src, dst, amount, position FROM (SELECT '0x' || tx_id AS tx_hash, src, dst, CAST(amount AS VARCHAR) AS amount, row_number() OVER (PARTITION BY tx_id ORDER BY rn DESC) - 1 AS position, id FROM pay) WHERE id % 10 <> 0 AND id % 7 <> 0")
def src_02(d):
    return _internal(d)[1]


@query("src_02_tx", "SELECT '0x' || tx_id AS tx_hash, min(block_height) AS block_height, min(block_ts) AS block_ts, CAST(NULL AS VARCHAR) AS fee, CASE WHEN arg_max(id, rn) % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM pay GROUP BY tx_id")
def src_02_tx(d):
    return _internal(d)[0]


def _approvals(d):
    topic = lambda n: F.concat(F.lit("0x"), F.lpad(F.upper(F.hex(n)), 64, "0"))
    i = F.col("event_id")
    rows = d.events.select(
        _hex(i % 7 + 1).alias("address"), F.when(i % 13 == 0, F.array(topic(F.col("k")))).otherwise(F.array(F.when(i % 3 == 0, "0xother").otherwise(F.upper(F.lit(p.APPROVAL_TOPIC))), topic(F.col("user_id")), topic(F.col("k")))).alias("topics"),
        F.when(i % 4 == 0, F.concat(F.lit("0x"), F.repeat(F.lit("f"), F.lit(64)))).when(i % 4 == 1, "0xzz").otherwise(F.concat(F.lit("0x"), F.hex(i))).alias("data"), F.concat(F.lit("0x"), F.hex(i)).alias("blockNumber"), F.concat(F.lit("t"), i % 50).alias("transactionHash"),
    )
    return p.adapt_approvals(_payload(rows))


_log = f"""lg AS (SELECT {_sql_hex('user_id')} AS owner, {_sql_hex('k')} AS spender, {_sql_hex('event_id % 7 + 1')} AS token, CASE WHEN event_id % 4 = 0 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' WHEN event_id % 4 <> 1 THEN CAST(event_id AS VARCHAR) END AS amount,
  event_id AS block_height, 't' || event_id % 50 AS tx_hash FROM ev WHERE event_id % 3 <> 0 AND event_id % 13 <> 0)"""


@query("src_04", f"WITH {_log} SELECT * FROM lg")
def src_04(d):
    return _approvals(d)


@query("enr_10", f"WITH {_log}, k AS (SELECT owner, spender, token, tx_hash, arg_min(amount, block_height) AS amount, min(block_height) AS block_height, bool_or(block_height < 500) AS old FROM (SELECT *, coalesce(amount, '-') FROM lg) GROUP BY 1, 2, 3, 4) SELECT owner, spender, token, tx_hash, block_height FROM k WHERE NOT old")
def enr_10(d):
    rows = _approvals(d)
    return e.register_approvals(rows, rows.filter("block_height < 500").select("owner", "spender", "token", "tx_hash").distinct())[1].drop("amount")


def _transfer_log(d):
    i, n = F.col("id"), F.substring("asset", 7, 9).cast("long")
    rows = d.transfer.select(
        i.alias("row"), F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("0x"), "tx_id")).alias("transactionHash"), F.when(i % 10 == 0, "BTC").when(i % 10 == 1, "tron").when(i % 10 == 2, "bsc").otherwise(" Ethereum ").alias("chain"),
        _hex(F.substring("src", 2, 20).cast("long")).alias("fromAddress"), F.when(i % 19 == 0, "0xbroken").otherwise(_hex(F.substring("dst", 2, 20).cast("long"))).alias("toAddress"), F.when(n == 1, "").otherwise(_hex(n)).alias("tokenAddress"),
        F.when(n == 1, "").otherwise(F.col("asset")).alias("tokenSymbol"), F.when(n == 1, "").otherwise("2").alias("tokenDecimals"), (F.col("amount") / 100).cast("decimal(20,2)").cast("string").alias("unitValue"), _text("block_height").alias("blockNumber"),
        F.when(i % 5 == 0, "").otherwise(_text("block_ts")).alias("blockTimestamp"), F.when(i % 3 == 0, F.concat(F.col("amount").cast("string"), F.lit(".5"))).alias("historicalUSD"),
    )
    return p.adapt_transfer_log(rows, {"btc": "bitcoin", "eth": "ethereum", "bnb": "bsc"}, ["ethereum", "bsc"], ["bitcoin"], {"ethereum": "ETH", "bsc": "BNB"})


_tlog = f"""tl AS (SELECT *, CAST(substr(asset, 7) AS BIGINT) = 1 AS nat, CASE id % 10 WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'tron' WHEN 2 THEN 'bsc' ELSE 'ethereum' END AS c,
    CASE WHEN id % 10 = 0 THEN 'rejected_utxo' WHEN id % 10 = 1 THEN 'unsupported' WHEN id % 17 = 0 THEN 'skipped' WHEN id % 19 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM transfer),
  tp AS (SELECT *, row_number() OVER (PARTITION BY c, tx_id, nat, outcome ORDER BY id) - 1 AS position FROM tl)"""


@query("src_07", f"""WITH {_tlog} SELECT id AS "row", outcome, c AS chain, CASE WHEN outcome = 'ok' THEN {_sql_hex("CAST(substr(src, 2) AS BIGINT)")} END AS src, CASE WHEN outcome = 'ok' THEN {_sql_hex("CAST(substr(dst, 2) AS BIGINT)")} END AS dst, CASE WHEN outcome = 'ok' THEN CASE WHEN nat THEN 'native' ELSE 'erc20' END END AS transfer_type,
  CASE WHEN outcome = 'ok' THEN CASE WHEN NOT nat THEN asset WHEN c = 'bsc' THEN 'BNB' ELSE 'ETH' END END AS symbol, CASE WHEN outcome = 'ok' THEN CASE WHEN nat AND amount <> 0 THEN amount || '0000000000000000' ELSE CAST(amount AS VARCHAR) END END AS amount, CASE WHEN outcome = 'ok' THEN position END AS position, CASE WHEN outcome = 'ok' AND id % 3 = 0 THEN amount || '.5' END AS historical_usd FROM tp""")
def src_07(d):
    return _transfer_log(d).select("row", "outcome", "chain", "src", "dst", "transfer_type", "symbol", "amount", "position", "historical_usd")


@query("agg_34", f"""WITH {_tlog} SELECT count(*) AS rows, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, 0 AS failed, count(*) FILTER (WHERE outcome = 'rejected_utxo') AS rejected_utxo,
  count(*) FILTER (WHERE outcome = 'unsupported') AS unsupported, count(*) FILTER (WHERE outcome = 'error') AS error, 0 AS rounded,
  count(*) FILTER (WHERE outcome = 'ok' AND amount % 100 <> 0 AND (nat OR amount % 10 = 0)) AS truncation_risk, bool_or(id % 1000 = 999) AS partial FROM tp""")
def agg_34(d):
    """The counters of the transfer log's import, from the run that writes its rows; a row of number 999 tells of a cut source."""
    return write_import(_transfer_log(d), new_folder(d.spark, "import"), F.col("row") % 1000 == 999)


@query("enr_08", f"WITH {_tlog} SELECT id, amount || '.5' AS value, 'log' AS source FROM tp WHERE outcome = 'ok' AND id % 3 = 0 AND id % 5 <> 0 AND id % 4 <> 0 AND amount <> 0")
def enr_08(d):
    rows = _transfer_log(d).filter("outcome = 'ok'").withColumnRenamed("row", "id")
    return e.reported_valuations(rows, rows.filter("id % 4 = 0").select("id", F.lit("log").alias("source")), "log").drop("unit_price")


@query("src_08", "SELECT CAST(tx_id AS VARCHAR) AS tx_hash, src, dst, CASE WHEN asset = 'Brand#1' THEN 'native' ELSE 'erc20' END AS transfer_type, CASE WHEN asset <> 'Brand#1' THEN lower(asset) END AS contract, CASE WHEN id % 9 = 0 THEN '0' ELSE CAST(amount AS VARCHAR) END AS amount FROM transfer")
def src_08(d):
    n = F.col("asset") == "Brand#1"
    one = F.struct(
        F.struct(_text("tx_id").alias("Hash")).alias("Transaction"), F.struct(_text("block_height").alias("Number"), _text("block_ts").alias("Time")).alias("Block"),
        F.struct(F.when(F.col("id") % 9 == 0, "n/a").otherwise((F.col("amount") / 100).cast("decimal(20,2)").cast("string")).alias("Amount"), F.upper("src").alias("Sender"), F.upper("dst").alias("Receiver"), F.struct(F.col("asset").alias("Symbol"), F.when(n, p.ZERO_ADDRESS).otherwise(F.col("asset")).alias("SmartContract"), F.lit("2").alias("Decimals")).alias("Currency")).alias("Transfer"),
    )
    rows = d.transfer.select(F.struct(F.struct(F.array(one).alias("Transfers")).alias("EVM")).alias("data"))
    return p.adapt_graphql(_payload(rows)).select("tx_hash", "src", "dst", "transfer_type", "contract", "amount")


def _levels(d):
    return p.adapt_confidence(d.spark.createDataFrame([(x,) for x in _LEVELS], "value string"))


@query("src_18", "SELECT DISTINCT l_linenumber % 4 AS line, CASE l_linenumber % 4 WHEN 0 THEN 'ownership' WHEN 1 THEN 'web_crawl' WHEN 2 THEN 'heuristic' END AS id, CAST(CASE l_linenumber % 4 WHEN 0 THEN 100 WHEN 1 THEN 20 WHEN 2 THEN 10 END AS INTEGER) AS level FROM lineitem WHERE l_linenumber % 4 <> 3")
def src_18(d):
    """The taxonomy's lines are projected from line numbers."""
    n = F.col("l_linenumber") % 4
    lines = d.read("lineitem").select(n.alias("line"), F.when(n == 0, " ownership , 100").when(n == 1, "web_crawl,20").when(n == 2, "heuristic,10").otherwise("# comment").alias("value")).distinct()
    found = p.adapt_confidence(lines)
    return lines.select("line", F.trim(F.split("value", ",")[0]).alias("id")).join(found, "id").select("line", "id", "level")


def _tags(d):
    """One pack per customer nation: its tags inherit confidence and category; every tenth has a currency of its own, every seventh no label."""
    k = F.col("c_custkey")
    tag = F.struct(_hex(k).alias("address"), F.when(k % 7 != 0, F.col("c_name")).alias("label"), F.when(k % 10 == 0, "DOGE").alias("currency"), F.when(k % 4 == 0, "web_crawl").when(k % 4 == 1, "unheard").alias("confidence"), F.when(k % 5 == 0, "scam").alias("abuse"), F.when(k % 3 == 0, F.concat(F.lit("actor"), k % 20)).alias("actor"), F.when(k % 2 == 0, "No").otherwise("yes").alias("is_cluster_definer"))
    packs = d.read("customer").groupBy("c_nationkey", (k % 8).alias("part")).agg(F.collect_list(tag).alias("tags")).select(F.lit("eth").alias("currency"), F.concat(F.lit("link"), "c_nationkey").alias("source"), F.struct(F.lit("ownership").alias("confidence"), F.lit("business").alias("category")).alias("header"), "tags")
    return p.adapt_tagpack(_payload(packs), _levels(d), _CHAINS)


_tag = f"""tg AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'unsupported' WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN c_custkey % 10 <> 0 THEN 'ethereum' END AS chain, {_sql_hex('c_custkey')} AS address, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS label,
  CASE c_custkey % 4 WHEN 0 THEN 0.2e0 WHEN 1 THEN NULL ELSE 1e0 END AS confidence, CASE c_custkey % 4 WHEN 0 THEN 'web_crawl' WHEN 1 THEN 'unheard' ELSE 'ownership' END AS confidence_id, 'link' || c_nationkey AS backlink, CASE WHEN c_custkey % 5 = 0 THEN 'scam' END AS abuse, CASE WHEN c_custkey % 3 = 0 THEN 'actor' || c_custkey % 20 END AS actor, c_custkey % 2 = 1 AS definer FROM customer)"""


@query("src_09", f"WITH {_tag} SELECT outcome, chain, CASE WHEN outcome = 'ok' THEN address END AS address, label, 'business' AS category, backlink, confidence, confidence_id, 'source: ' || backlink || ' | confidence: ' || confidence_id AS note, abuse, actor, definer AS cluster_definer FROM tg")
def src_09(d):
    return _tags(d).drop("pack", "tag")


@query("enr_03", f"WITH {_tag} SELECT DISTINCT chain, address, label, 'business' AS category, confidence, 'source: ' || backlink || ' | confidence: ' || confidence_id AS note FROM tg WHERE outcome = 'ok'")
def enr_03(d):
    return e.tag_attributions(_tags(d))


@query("enr_04", f"WITH {_tag} SELECT DISTINCT chain, address, abuse AS category, label || ' — ' || backlink AS rationale FROM tg WHERE outcome = 'ok' AND abuse IS NOT NULL")
def enr_04(d):
    return e.tag_risks(_tags(d))


def _actors(d):
    n = F.col("n_nationkey")
    actor = F.struct(F.concat(F.lit("actor"), n).alias("id"), F.when(n % 6 != 0, F.col("n_name")).alias("label"), F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("exchange"), F.lit("other"))).alias("categories"))
    return p.adapt_actorpack(_payload(d.read("nation").groupBy("n_regionkey").agg(F.collect_list(actor).alias("actors")).select("actors")))


@query("src_10", "SELECT 'actor' || n_nationkey AS external_id, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN 'exchange' END AS kind FROM nation WHERE n_nationkey % 6 <> 0")
def src_10(d):
    return _actors(d)


@query("enr_05", f"""WITH {_tag}, ids AS (SELECT 'actor' || n_nationkey AS external_id FROM nation WHERE n_nationkey % 6 <> 0 UNION SELECT actor FROM tg WHERE outcome = 'ok' AND actor IS NOT NULL)
  SELECT external_id, coalesce(n_name, external_id) AS name, CASE WHEN n_name IS NOT NULL AND n_nationkey % 4 <> 0 THEN 'exchange' WHEN external_id IN (SELECT actor FROM tg WHERE outcome = 'ok') THEN 'business' END AS kind
  FROM ids LEFT JOIN nation ON external_id = 'actor' || n_nationkey AND n_nationkey % 6 <> 0""")
def enr_05(d):
    return e.actor_entities(_actors(d), _tags(d))


@query("enr_05_members", f"WITH {_tag} SELECT actor AS external_id, chain, address, max(confidence) AS confidence, CASE WHEN bool_or(definer) THEN 'cluster-definer' END AS flags FROM tg WHERE outcome = 'ok' AND actor IS NOT NULL GROUP BY 1, 2, 3")
def enr_05_members(d):
    return e.actor_memberships(_tags(d))


def _sanctions(d):
    k = F.col("s_suppkey")
    ident = lambda kind, number: F.concat(F.lit("<id><uid>1</uid><idType>"), kind, F.lit("</idType><idNumber>"), number, F.lit("</idNumber></id>"))
    who = F.when(k % 2 == 0, F.concat(F.lit("<firstName>Ann</firstName><lastName>"), "s_name", F.lit("</lastName><sdnType>Individual</sdnType>"))).otherwise(F.concat(F.lit("<lastName>"), F.col("s_name"), F.lit("</lastName><sdnType>Entity</sdnType>")))
    programs = F.when(k % 3 != 0, F.lit("<programList><program>CYBER2</program><program>DPRK3</program></programList>")).otherwise("")
    kind = F.concat(F.lit(p.DIGITAL_CURRENCY), F.when(k % 5 == 0, "XMR").otherwise("ETH"))
    entry = F.concat(F.lit("<sdnEntry><uid>"), k.cast("string"), F.lit("</uid>"), who, programs, F.lit("<idList>"), ident(F.lit("Passport"), F.lit("P1")), ident(kind, F.when(k % 11 == 0, "0xbad").otherwise(_hex(k))), F.lit("</idList></sdnEntry>"))
    return p.adapt_sanctions(d.read("supplier").select(F.when(k % 23 == 0, F.concat(F.lit("<!DOCTYPE x>"), entry)).otherwise(entry).alias("payload")), _CHAINS)


@query("src_11", f"""SELECT CASE WHEN s_suppkey % 23 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS uid, CASE WHEN s_suppkey % 23 = 0 THEN 'error' WHEN s_suppkey % 5 = 0 THEN 'unsupported' WHEN s_suppkey % 11 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN s_suppkey % 23 <> 0 AND s_suppkey % 5 <> 0 THEN 'ethereum' END AS chain,
  CASE WHEN s_suppkey % 23 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0 THEN {_sql_hex('s_suppkey')} END AS address, CASE WHEN s_suppkey % 23 <> 0 THEN 'OFAC SDN: ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ', Ann' ELSE '' END || CASE WHEN s_suppkey % 3 <> 0 THEN ' (CYBER2, DPRK3)' ELSE '' END END AS rationale FROM supplier""")
def src_11(d):
    return _sanctions(d).select("uid", "outcome", "chain", "address", "rationale")


def _intel(d):
    k = F.col("c_custkey")
    named = lambda test, ident, name: F.when(test, F.struct(ident.alias("id"), name.alias("name"), F.lit("fund").alias("type")))
    rows = d.read("customer").select(
        _hex(k).alias("address"), named(k % 3 != 0, F.when(k % 2 == 0, F.concat(F.lit("e"), k)), F.col("c_name")).alias("arkhamEntity"), named(k % 4 == 0, F.lit(None).cast("string"), F.col("c_name")).alias("predictedEntity"),
        F.when(k % 5 == 0, F.struct(F.col("c_mktsegment").alias("name"))).alias("arkhamLabel"), F.when(k % 7 == 0, F.concat(F.lit(" svc"), k % 3)).alias("depositServiceID"),
    )
    return p.adapt_address_intel(_payload(rows))


_ent = f"""en AS (SELECT {_sql_hex('c_custkey')} AS address, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey ELSE 'arkham:' || c_name || ':arkham-entity' END AS external_id, c_name AS name, 'fund' AS kind, 0.95e0 AS confidence, 'arkham-entity' AS method FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT {_sql_hex('c_custkey')}, 'arkham:' || c_name || ':arkham-predicted', c_name, 'fund', 0.5e0, 'arkham-predicted' FROM customer WHERE c_custkey % 4 = 0)"""


@query("src_13", f"WITH {_ent} SELECT * FROM en")
def src_13(d):
    return _intel(d)[0]


@query("src_13_claims", f"""SELECT {_sql_hex('c_custkey')} AS address, c_name AS label, 'fund' AS category, 0.5e0 AS confidence, 'arkham predicted entity (probabilistic)' AS note FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT {_sql_hex('c_custkey')}, c_mktsegment, NULL, 0.95e0, 'arkham label' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT {_sql_hex('c_custkey')}, 'svc' || c_custkey % 3, 'deposit_service', NULL, 'deposit address -> service' FROM customer WHERE c_custkey % 7 = 0""")
def src_13_claims(d):
    return _intel(d)[1]


@query("enr_06", f"WITH {_ent} SELECT external_id, address, method, max(confidence) AS confidence FROM en GROUP BY 1, 2, 3")
def enr_06(d):
    return e.vendor_memberships(_intel(d)[0])


def _headline(d):
    k = F.col("doc_id")
    rows = d.read("labels").select(_hex(k).alias("address"), F.when(k % 6 != 0, (k % 100).cast("double")).alias("max_score"), F.lit("high").alias("risk_level"), F.when(k % 2 == 0, "mixer").alias("greatest_risk_category"), (k % 4).cast("double").alias("mixer_score"), F.col("toxic").cast("double").alias("hacker_score"))
    return p.adapt_headline_risk(_payload(rows))


@query("src_14", f"SELECT {_sql_hex('doc_id')} AS address, 'mixer' AS signal, CAST(doc_id % 4 AS DOUBLE) AS score FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT {_sql_hex('doc_id')}, 'hacker', CAST(toxic AS DOUBLE) FROM labels WHERE toxic <> 0")
def src_14(d):
    return _headline(d)[1]


@query("enr_07", f"""WITH s AS (SELECT * FROM labels WHERE doc_id % 6 <> 0) SELECT {_sql_hex('doc_id')} AS address, 'headline' AS level, CASE WHEN doc_id % 2 = 0 THEN 'mixer' END AS category, CAST(doc_id % 100 AS DOUBLE) AS score FROM s UNION ALL SELECT {_sql_hex('doc_id')}, 'signal', 'mixer', CAST(doc_id % 4 AS DOUBLE) FROM s WHERE doc_id % 4 <> 0
  UNION ALL SELECT {_sql_hex('doc_id')}, 'signal', 'hacker', CAST(toxic AS DOUBLE) FROM s WHERE toxic <> 0""")
def enr_07(d):
    return e.risk_rows(*_headline(d))


@query("src_15", f"""SELECT {_sql_hex('doc_id')} AS address, CAST(doc_id % 98 + 3 AS DOUBLE) AS score, CASE WHEN quality = 0 THEN 'scam' ELSE 'mixer' END AS category, 'moderate | a; b | mixer:m (direct, hop 1, $5, 40.0%) | scam:s (direct, hop 2, $6, ' || CASE WHEN quality = 0 THEN '60.0' ELSE '10.0' END || '%)' AS rationale FROM labels""")
def src_15(d):
    detail = lambda kind, name, hop, volume, share: F.struct(F.lit(name).alias("entity"), F.lit(kind).alias("risk_type"), F.lit("direct").alias("exposure_type"), F.lit(hop).alias("hop_num"), F.lit(volume).alias("volume"), share.cast("double").alias("percent"))
    rows = d.read("labels").select(_hex(F.col("doc_id")).alias("address"), (F.col("doc_id") % 98 + 3).cast("double").alias("score"), F.lit("moderate").alias("risk_level"), F.array(F.lit("a"), F.lit("b")).alias("detail_list"), F.array(detail("mixer", "m", "1", "5", F.lit(40)), detail("scam", "s", "2", "6", F.when(F.col("quality") == 0, 60).otherwise(10))).alias("risk_detail"))
    return p.adapt_vendor_risk(_payload(rows))[0].drop("score_scale")


@query("src_15_labels", f"SELECT {_sql_hex('c_custkey')} AS address, c_mktsegment AS label, 'seg' AS category, CASE WHEN c_custkey % 2 = 0 THEN 'tags: x, y' END AS note FROM customer WHERE c_custkey % 3 <> 0")
def src_15_labels(d):
    k = F.col("c_custkey")
    labels = F.when(k % 3 == 0, F.array(F.lit(" "))).when(k % 2 == 0, F.array(F.lit(""), F.col("c_mktsegment"), F.lit("x "), F.lit("y"))).otherwise(F.array("c_mktsegment"))
    return p.adapt_vendor_labels(_payload(d.read("customer").select(_hex(k).alias("address"), labels.alias("label_list"), F.lit("seg ").alias("label_type"))))


def _screened(d):
    k = F.col("doc_id")
    hit = F.struct(F.when(k % 2 == 0, "pep").alias("category"), F.when(k % 3 != 0, "Name").alias("name"), F.lit("listed").alias("description"))
    return p.adapt_screening(_payload(d.read("labels").select(_hex(k).alias("address"), F.when(k % 5 != 0, F.when(F.col("toxic") == 1, F.array(hit, hit)).otherwise(F.array(hit))).alias("identifications"))))


@query("src_16", f"SELECT {_sql_hex('doc_id')} AS address, CASE WHEN doc_id % 2 = 0 THEN 'pep' ELSE 'sanctioned' END AS category, CASE WHEN doc_id % 3 <> 0 THEN 'Name — listed' ELSE 'listed' END AS rationale FROM labels, range(2) t(i) WHERE doc_id % 5 <> 0 AND i <= toxic")
def src_16(d):
    return _screened(d)[0]


@query("src_16_log", f"SELECT {_sql_hex('doc_id')} AS address, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 + toxic END AS BIGINT) AS identifications FROM labels")
def src_16_log(d):
    return _screened(d)[1]


@query("scl_09", "SELECT id, CASE WHEN value_e4 >= 10000 THEN '$' || format('{:,.2f}', CAST(value_e4 AS DOUBLE) / 10000) WHEN value_e4 IS NOT NULL THEN '$' || CASE WHEN value_e4 = 0 THEN '0' ELSE rtrim(rtrim(format('{:.4f}', CAST(value_e4 AS DOUBLE) / 10000), '0'), '.') END END AS label FROM valued")
def scl_09(d):
    return d.valued.select("id", usd_label(F.col("value_e4") / 10_000).alias("label"))


@query("snk_02", "SELECT CASE WHEN tx_id % 5 = 0 THEN 'raw/' ELSE 'db/' END || tx_id AS path, sha256(chain) AS digest FROM tx WHERE tx_id % 9 <> 0")
def snk_02(d):
    """Digests of contents as they stand in a table; build_manifest takes the same from files."""
    rows = d.tx.select(F.concat(F.when(F.col("tx_id") % 5 == 0, "raw/").otherwise("db/"), "tx_id", F.when(F.col("tx_id") % 9 == 0, ".tmp").otherwise("")).alias("path"), F.col("chain").cast("binary").alias("content"))
    return p.manifest_of(rows)


_refs = "CASE tx_id % 6 WHEN 0 THEN '/etc/' || tx_id WHEN 1 THEN 'a/../' || tx_id WHEN 2 THEN '' ELSE 'raw/' || tx_id END"


@query("snk_04", f"SELECT {_refs} AS path, CASE WHEN tx_id % 6 < 2 THEN 'unsafe' ELSE 'absent' END AS problem FROM tx WHERE tx_id % 6 < 2 OR (tx_id % 6 > 2 AND tx_id % 10 = 4)")
def snk_04(d):
    return p.check_references(*_referenced(d))


def _referenced(d):
    n = F.col("tx_id")
    refs = d.tx.select(F.when(n % 6 == 0, F.concat(F.lit("/etc/"), n)).when(n % 6 == 1, F.concat(F.lit("a/../"), n)).when(n % 6 == 2, "").otherwise(F.concat(F.lit("raw/"), n)).alias("path"))
    return refs, d.tx.filter("tx_id % 10 <> 4").select(F.concat(F.lit("raw/"), "tx_id").alias("path"))


@query("snk_06", """SELECT 'manifest' AS part, true AS ok, CAST(0 AS BIGINT) AS problems UNION ALL SELECT 'references', count(*) = 0, count(*) FROM tx WHERE tx_id % 6 < 2 OR (tx_id % 6 > 2 AND tx_id % 10 = 4)
  UNION ALL SELECT 'audits', NOT bool_or(n > 0), CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) FROM (SELECT count(*) AS n FROM claim WHERE id % 10 = 0 UNION ALL SELECT 0)""")
def snk_06(d):
    refs, files = _referenced(d)
    hashed = files.withColumn("digest", F.sha2("path", 256))
    return p.verify_bundle(hashed, hashed, refs, rosters.run_audits({"idempotency": d.claim.filter("id % 10 = 0"), "no-fabricated-edge": d.tx_output.filter("address is null").select("id")}))


@query("top_06", "SELECT address, category, source, row_number() OVER (ORDER BY address, category, source) AS place FROM risk")
def top_06(d):
    """Rosters are put in order by all their columns; places come from a range-partitioned sort, not from one task."""
    return rosters.numbered(d.risk.select("address", "category", "source"), ["address", "category", "source"])


@query("enr_13", "SELECT 'risk' AS roster, count(*) AS rows FROM risk UNION ALL SELECT 'attribution', count(*) FROM attribution UNION ALL SELECT 'approval', count(*) FROM approval UNION ALL SELECT 'source_query', count(*) FROM source_query")
def enr_13(d):
    import uuid

    folder = f"{shared_dir(d.spark)}/evidence-{uuid.uuid4().hex}"
    return e.evidence({"risk": d.risk, "attribution": d.attribution, "approval": d.approval, "source_query": d.source_query}, folder)
