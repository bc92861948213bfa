"""Queries of sources and sinks: projected rows are serialised to payloads in the plan and normalised again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import shift_point
from ..scratch import new_folder
from ..sources import payloads as p
from ..sources.imports import write_import
from .registry import Registry

REGISTRY = query = Registry()


def _text(name):
    return F.col(name).cast("string")


def _txlist(d):
    rows = d.payments.select(F.concat(F.lit("0x"), "id").alias("hash"), _text("block_height").alias("blockNumber"), _text("block_ts").alias("timeStamp"), F.upper("src").alias("from"), F.upper("dst").alias("to"), F.when(F.col("id") % 10 == 0, "0").otherwise(_text("amount")).alias("value"), _text("line").alias("gasUsed"), F.lit("7").alias("gasPrice"), F.when(F.col("id") % 7 == 0, "1").otherwise("0").alias("isError"))
    return p.adapt_txlist(rows.select(F.to_json(F.struct("*")).alias("payload")))


@query("src_01", "SELECT '0x' || id AS tx_hash, src, dst, CAST(amount AS VARCHAR) AS amount, 0 AS position FROM pay WHERE id % 10 <> 0 AND id % 7 <> 0")
def src_01(d):
    return _txlist(d)[1]


@query("src_01_tx", "SELECT '0x' || id AS tx_hash, block_height, block_ts, CAST(line * 7 AS VARCHAR) AS fee, CASE WHEN id % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM pay")
def src_01_tx(d):
    return _txlist(d)[0]


@query("src_03", "SELECT '0x' || id AS tx_hash, src, dst, lower(asset) AS contract, asset AS symbol, CASE WHEN id % 3 = 0 THEN 0 ELSE 6 END AS decimals, CAST(amount AS VARCHAR) AS amount FROM transfer")
def src_03(d):
    rows = d.transfer.select(F.concat(F.lit("0x"), "id").alias("hash"), F.upper("src").alias("from"), F.upper("dst").alias("to"), _text("amount").alias("value"), F.col("asset").alias("contractAddress"), F.col("asset").alias("tokenSymbol"), F.when(F.col("id") % 3 == 0, "").otherwise("6").alias("tokenDecimal"))
    return p.adapt_tokentx(rows.select(F.to_json(F.struct("*")).alias("payload")))


@query("src_05", "SELECT CAST(tx_id AS VARCHAR) AS tx_hash, output_index, address, amount FROM tx_output")
def src_05(d):
    out = F.struct(F.col("output_index"), F.col("address").alias("scriptpubkey_address"), F.col("amount").alias("value"))
    rows = d.tx_output.groupBy(_text("tx_id").alias("txid")).agg(F.transform(F.array_sort(F.collect_list(out)), lambda x: F.struct(x["scriptpubkey_address"].alias("scriptpubkey_address"), x["value"].alias("value"))).alias("vout"))
    return p.adapt_utxo(rows.select(F.to_json(F.struct("*")).alias("payload")))[1].withColumn("output_index", F.col("output_index").cast("long"))


def _explorer_csv(d):
    shown, side = shift_point(F.col("amount"), 2), F.col("id") % 2 == 0
    return d.transfer.select(_text("id").alias("tx_hash"), F.upper("src").alias("src"), F.upper("dst").alias("dst"), F.when(side, "0").otherwise(shown).alias("value_out"), F.when(side, shown).otherwise("").alias("value_in"), F.when(F.col("id") % 6 == 0, "Error(0)").otherwise("").alias("status"))


@query("src_06", "SELECT CAST(id AS VARCHAR) AS tx_hash, src, dst, CAST(amount AS VARCHAR) || '0000000000000000' AS amount FROM transfer WHERE amount <> 0 AND id % 6 <> 0")
def src_06(d):
    return p.adapt_explorer_csv(_explorer_csv(d))


@query("agg_34_csv", """SELECT count(*) AS rows, count(*) FILTER (WHERE id % 6 <> 0 AND amount <> 0) AS ok, count(*) FILTER (WHERE id % 6 <> 0 AND amount = 0) AS skipped, count(*) FILTER (WHERE id % 6 = 0) AS failed,
  0 AS rejected_utxo, 0 AS unsupported, 0 AS error, 0 AS rounded, count(*) FILTER (WHERE id % 6 <> 0 AND amount % 100 <> 0) AS truncation_risk, false AS partial FROM transfer""")
def agg_34_csv(d):
    return write_import(p.classify_explorer_csv(_explorer_csv(d)), new_folder(d.spark, "import"))


@query("src_12", "SELECT asset AS price_key, price_ts, price_cents / 100e0 AS price FROM price WHERE price_cents % 5 <> 0")
def src_12(d):
    one = F.struct(F.when(F.col("price_cents") % 5 != 0, F.col("price_cents") / 100).alias("price"), F.col("price_ts").alias("timestamp"))
    rows = d.price.select(F.struct(F.create_map(F.col("asset"), one).alias("coins")).alias("r"))
    return p.adapt_prices(rows.select(F.to_json("r").alias("payload")))


@query("src_17", "SELECT address, (sum(amount) - coalesce((SELECT sum(amount) FROM tx_input i WHERE i.address = o.address), 0))::BIGINT AS balance FROM tx_output o GROUP BY address")
def src_17(d):
    spent = d.tx_input.groupBy("address").agg(F.sum("amount").alias("spent"))
    return p.balance(d.tx_output.groupBy("address").agg(F.sum("amount").alias("funded")).join(spent, "address", "left"))


@query("snk_03", "SELECT tx_id AS path, CASE WHEN tx_id % 10 = 0 THEN 'missing' WHEN tx_id % 11 = 0 THEN 'extra' ELSE 'mismatched' END AS problem FROM tx WHERE (tx_id % 10 = 0 AND tx_id % 11 <> 0) OR (tx_id % 11 = 0 AND tx_id % 10 <> 0) OR (tx_id % 13 = 0 AND tx_id % 10 <> 0 AND tx_id % 11 <> 0)")
def snk_03(d):
    rows = d.tx.select(F.col("tx_id").alias("path"), F.sha2("chain", 256).alias("digest"))
    files = rows.filter("path % 10 <> 0").withColumn("digest", F.when(F.col("path") % 13 == 0, "x").otherwise(F.col("digest")))
    return p.verify_manifest(rows.filter("path % 11 <> 0"), files)


@query("snk_05", "SELECT id, tx_id AS path FROM transfer WHERE tx_id % 10 = 4")
def snk_05(d):
    return p.missing_payloads(d.transfer.select("id", F.col("tx_id").alias("path")), d.tx.filter("tx_id % 10 <> 4").select(F.col("tx_id").alias("path")))
