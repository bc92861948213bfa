"""Normalising landed payload rows into canonical rows (SRC-01, 03, 05, 06, 12, 17; SNK-03, SNK-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_failed, to_base_units

TX = "hash string, blockNumber string, timeStamp string, `from` string, `to` string, value string, gasUsed string, gasPrice string, isError string"
TOKEN = "hash string, blockNumber string, timeStamp string, `from` string, `to` string, value string, contractAddress string, tokenSymbol string, tokenDecimal string"
UTXO = "txid string, status struct<confirmed: boolean, block_height: long>, vin array<struct<txid: string, vout: long, is_coinbase: boolean, prevout: struct<scriptpubkey_address: string, value: long>>>, vout array<struct<scriptpubkey_address: string, value: long>>"
PRICES = "coins map<string, struct<price: double, symbol: string, timestamp: long, confidence: double>>"


def read_json(rows: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """Payload texts by an explicit schema; a row that is no JSON has only nulls."""
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")


def adapt_txlist(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-01: transactions, and native transfers of those that did not fail and moved something."""
    r = read_json(rows, TX).filter("hash is not null")
    failed = is_failed(F.col("isError"), F.lit(None).cast("string"))
    fee = (F.col("gasUsed").try_cast("decimal(19,0)") * F.col("gasPrice").try_cast("decimal(18,0)")).cast("string")
    tx = r.select(F.col("hash").alias("tx_hash"), F.col("blockNumber").try_cast("bigint").alias("block_height"), F.col("timeStamp").try_cast("bigint").alias("block_ts"), fee.alias("fee"), F.when(failed, "failed").otherwise("success").alias("status"))
    moved = r.filter(~failed & (F.coalesce("value", F.lit("0")) != "0"))
    return tx, moved.select(F.col("hash").alias("tx_hash"), F.lower("from").alias("src"), F.lower("to").alias("dst"), F.col("value").alias("amount"), F.lit(0).alias("position"))


def adapt_tokentx(rows: DataFrame) -> DataFrame:
    """SRC-03: token transfers with their asset; blank decimals are 0."""
    r = read_json(rows, TOKEN).filter("hash is not null")
    return r.select(F.col("hash").alias("tx_hash"), F.lower("from").alias("src"), F.lower("to").alias("dst"), F.lower("contractAddress").alias("contract"), F.col("tokenSymbol").alias("symbol"), F.coalesce(F.col("tokenDecimal").try_cast("int"), F.lit(0)).alias("decimals"), F.col("value").alias("amount"))


def adapt_utxo(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-05: inputs and outputs of UTXO transactions; a coinbase input moves nothing and has no address."""
    r = read_json(rows, UTXO).filter("txid is not null")
    i = r.select(F.col("txid").alias("tx_hash"), F.posexplode("vin").alias("input_index", "v"))
    base = F.coalesce(F.col("v.is_coinbase"), F.lit(False))
    inputs = i.select("tx_hash", "input_index", F.when(~base, F.col("v.txid")).alias("prev_tx"), F.when(~base, F.col("v.vout")).alias("prev_index"), F.when(~base, F.col("v.prevout.scriptpubkey_address")).alias("address"), F.when(base, 0).otherwise(F.col("v.prevout.value")).cast("long").alias("amount"))
    outputs = r.select(F.col("txid").alias("tx_hash"), F.posexplode("vout").alias("output_index", "v")).select("tx_hash", "output_index", F.col("v.scriptpubkey_address").alias("address"), F.col("v.value").alias("amount"))
    return inputs, outputs


def classify_explorer_csv(rows: DataFrame, decimals: int = 18) -> DataFrame:
    """SRC-06: tx_hash, src, dst, amount, outcome, rounded, truncation_risk of every row of an explorer's CSV export: the amount out if it is not zero, else in;
    failed transactions, skipped are those that move nothing, error those whose amounts are no numbers.

    rows: tx_hash, src, dst, value_in, value_out, status, all text, as renamed from the export's headers.
    """
    out, into = to_base_units(F.col("value_out"), F.lit(decimals)), to_base_units(F.col("value_in"), F.lit(decimals))
    r = rows.withColumn("out", out).withColumn("into", into)
    used = F.when(F.coalesce(F.col("out.amount"), F.lit("0")) != "0", F.col("out")).otherwise(F.col("into"))
    said = (F.coalesce(F.trim("value_out"), F.lit("")) != "") & F.col("out").isNull() | (F.coalesce(F.trim("value_in"), F.lit("")) != "") & F.col("into").isNull()
    outcome = F.when(is_failed(F.lit(None).cast("string"), F.col("status")), "failed").when(F.coalesce(F.col("used.amount"), F.lit("0")) != "0", "ok").when(said, "error").otherwise("skipped")
    return r.withColumn("used", used).select("tx_hash", F.lower("src").alias("src"), F.lower("dst").alias("dst"), F.col("used.amount").alias("amount"), outcome.alias("outcome"), F.col("used.rounded").alias("rounded"), F.col("used.truncation_risk").alias("truncation_risk"))


def adapt_explorer_csv(rows: DataFrame, decimals: int = 18) -> DataFrame:
    """SRC-06: native transfers of an explorer's CSV export; failed rows and those that move nothing go."""
    return classify_explorer_csv(rows, decimals).filter("outcome = 'ok'").select("tx_hash", "src", "dst", "amount")


def adapt_prices(rows: DataFrame) -> DataFrame:
    """SRC-12: one row for each price that is there."""
    return read_json(rows, PRICES).select(F.explode("coins").alias("price_key", "p")).filter("p.price is not null").select("price_key", F.col("p.timestamp").alias("price_ts"), F.col("p.price").alias("price"))


def balance(rows: DataFrame) -> DataFrame:
    """SRC-17: funded less spent."""
    return rows.select("address", (F.coalesce("funded", F.lit(0)) - F.coalesce("spent", F.lit(0))).cast("long").alias("balance"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-03: files that are missing, differ, or are extra, by path and digest."""
    both = manifest.select("path", F.col("digest").alias("stated")).join(files.select("path", F.col("digest").alias("found")), "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("stated").isNull(), "extra").when(F.col("found") != F.col("stated"), "mismatched")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def missing_payloads(references: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-05: references to raw payloads that have no file."""
    return references.join(files.select("path").distinct(), "path", "left_anti")
