"""Normalising internal transactions, approvals, transfer logs, tag packs, sanctions and vendor payloads (SRC-02, 04, 07 to 11, 13 to 16, 18; SNK-02, 04, 06)."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import canonical_address, entity_name, is_failed, lookup, note, to_base_units, topic_address, trace_key, truthy
from .payloads import read_json, verify_manifest

INTERNAL = "hash string, blockNumber string, timeStamp string, `from` string, `to` string, value string, traceId string, isError string"
LOGS = "address string, topics array<string>, data string, blockNumber string, transactionHash string"
GRAPHQL = "data struct<EVM: struct<Transfers: array<struct<Transaction: struct<Hash: string>, Block: struct<Number: string, Time: string>, Transfer: struct<Amount: string, Sender: string, Receiver: string, Currency: struct<Symbol: string, SmartContract: string, Decimals: string>>>>>>"
_TAG = "address string, label string, currency string, source string, confidence string, category string, abuse string, actor string, is_cluster_definer string"
TAGPACK = f"title string, {_TAG}, header struct<{_TAG.replace(' string', ': string')}>, tags array<struct<{_TAG.replace(' string', ': string')}>>"
ACTORPACK = "actors array<struct<id: string, label: string, categories: array<string>>>"
SDN_ENTRY = "uid string, firstName string, lastName string, sdnType string, programList struct<program: array<string>>, idList struct<id: array<struct<uid: string, idType: string, idNumber: string>>>"
_NAMED = "struct<id: string, name: string, type: string>"
ADDRESS_INTEL = f"address string, arkhamEntity {_NAMED}, predictedEntity {_NAMED}, arkhamLabel struct<name: string>, depositServiceID string"
VENDOR_RISK = "address string, score double, risk_level string, hacking_event string, detail_list array<string>, risk_detail array<struct<entity: string, risk_type: string, exposure_type: string, hop_num: string, volume: string, percent: double>>"
VENDOR_LABELS = "address string, label_list array<string>, label_type string"
SCREENING = "address string, identifications array<struct<category: string, name: string, description: string>>"

# They must equal what the sources use.
APPROVAL_TOPIC = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
DIGITAL_CURRENCY = "Digital Currency Address - "
CONFIRMED, PREDICTED = 0.95, 0.50
RISK_CATEGORIES = ["hacker", "mixer", "sanctions", "ransomware", "scam", "ponzi", "darkweb", "gambling", "privacy", "non_kyc_service", "mixed_kyc_service", "token_blacklist", "sanctioned_1hop"]
HEADLINE_RISK = "address string, max_score double, risk_level string, greatest_risk_category string, hop_distance string, is_seed string, " + ", ".join(f"{c}_score double" for c in RISK_CATEGORIES)


@F.pandas_udf(StringType())
def hex_to_decimal(text: pd.Series) -> pd.Series:
    """UDF-01: a hex number of any length as decimal text; '0x' and empty are 0, no number is null. Words of 256 bits exceed every numeric type."""

    def number(x):
        try:
            return str(int(x or "0x0", 16)) if x != "0x" else None
        except ValueError:
            return None

    return pd.Series([number(x) for x in text], dtype=object)


def adapt_internal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-02: transactions (fee unknown) and internal transfers; the position counts all calls of a transaction in order of traceId."""
    r = read_json(rows, INTERNAL).filter("hash is not null").withColumn("failed", is_failed(F.col("isError"), F.lit(None).cast("string")))
    first = r.groupBy(F.col("hash").alias("tx_hash")).agg(
        F.min(F.col("blockNumber").try_cast("bigint")).alias("block_height"), F.min(F.col("timeStamp").try_cast("bigint")).alias("block_ts"), F.lit(None).cast("string").alias("fee"), F.min_by(F.when(F.col("failed"), "failed").otherwise("success"), trace_key(F.col("traceId"))).alias("status")
    )
    order = W.partitionBy("hash").orderBy(trace_key(F.col("traceId")), "from", "to", "value")
    placed = r.withColumn("position", (F.row_number().over(order) - 1).cast("long")).filter(~F.col("failed") & (F.coalesce("value", F.lit("0")) != "0"))
    return first, placed.select(F.col("hash").alias("tx_hash"), F.lower("from").alias("src"), F.lower("to").alias("dst"), F.col("value").alias("amount"), "position")


def adapt_approvals(rows: DataFrame, chain: str = "ethereum") -> DataFrame:
    """SRC-04: owner, spender, token, amount, block_height, tx_hash of approval logs; other logs and malformed ones go."""
    r = read_json(rows, LOGS).filter((F.size("topics") >= 3) & (F.lower(F.col("topics")[0]) == APPROVAL_TOPIC))
    side = lambda i: F.when(F.col("topics")[i].rlike("^0x[0-9a-fA-F]{40,64}$"), topic_address(F.col("topics")[i]))
    token, _ = canonical_address(F.lit(chain), F.col("address"))
    out = r.select(side(1).alias("owner"), side(2).alias("spender"), token.alias("token"), hex_to_decimal("data").alias("amount"), F.conv(F.regexp_extract("blockNumber", "^0x([0-9a-fA-F]{1,15})$", 1), 16, 10).try_cast("bigint").alias("block_height"), F.col("transactionHash").alias("tx_hash"))
    return out.filter("owner is not null and spender is not null and token is not null")


def adapt_transfer_log(rows: DataFrame, aliases: Mapping[str, str], account_chains: list[str], utxo_chains: list[str], native: Mapping[str, str]) -> DataFrame:
    """SRC-07: transfers of a multichain CSV log, each row with its outcome: ok, rejected_utxo, unsupported, skipped or error.

    rows: row (order in the file) and the log's columns, all text. A row with a token is an erc20 transfer, else a native
    one; positions count the ok rows of a (chain, transaction, type) in file order. historical_usd is the source's total,
    verbatim; rounded and truncation_risk mark amounts whose digits do not fit the decimals.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    raw = F.lower(text("chain"))
    chain = F.coalesce(lookup(aliases, raw), raw)
    token, bad_token = canonical_address(chain, text("tokenAddress"))
    is_native = text("tokenAddress") == ""
    decimals = F.coalesce(text("tokenDecimals").try_cast("int"), F.when(is_native, 18).otherwise(0))
    units = to_base_units(text("unitValue"), decimals)
    height = text("blockNumber")
    end = lambda c: F.when(text(c) != "", F.struct(*(x.alias(n) for x, n in zip(canonical_address(chain, text(c)), ("form", "error")))))
    r = rows.withColumns({"c": chain, "u": units, "s": end("fromAddress"), "d": end("toAddress"), "native": is_native, "n": decimals})
    broken = F.col("u").isNull() | F.col("s.error").isNotNull() | F.col("d.error").isNotNull() | (~is_native & bad_token.isNotNull()) | ((height != "") & height.try_cast("bigint").isNull())
    outcome = (
        F.when(F.col("c").isin(utxo_chains), "rejected_utxo").when((F.col("c") != "") & ~F.col("c").isin(account_chains), "unsupported")
        .when((text("transactionHash") == "") | (F.col("c") == "") | (text("unitValue") == ""), "skipped").when(broken, "error").otherwise("ok")
    )
    r = r.withColumn("outcome", outcome)
    kind = F.when(F.col("native"), "native").otherwise("erc20")
    order = W.partitionBy("c", "transactionHash", "native", "outcome").orderBy("row")
    ok = F.col("outcome") == "ok"
    return r.select(
        "row", "outcome", F.col("c").alias("chain"), text("transactionHash").alias("tx_hash"), F.when(ok, F.col("s.form")).alias("src"), F.when(ok, F.col("d.form")).alias("dst"), F.when(ok, kind).alias("transfer_type"),
        F.when(ok & ~F.col("native"), token).alias("contract"), F.when(ok, F.coalesce(F.nullif(text("tokenSymbol"), F.lit("")), F.when(F.col("native"), F.coalesce(lookup(native, F.col("c")), F.lit("ETH"))))).alias("symbol"),
        F.when(ok, F.col("n")).alias("decimals"), F.when(ok, F.col("u.amount")).alias("amount"), F.when(ok, F.col("u.rounded")).alias("rounded"), F.when(ok, F.col("u.truncation_risk")).alias("truncation_risk"),
        F.when(ok, height.try_cast("bigint")).alias("block_height"), F.when(ok, text("blockTimestamp")).alias("block_ts"), F.when(ok, F.row_number().over(order) - 1).cast("long").alias("position"),
        F.when(ok & text("historicalUSD").rlike(r"^-?\d+(\.\d+)?$"), text("historicalUSD")).alias("historical_usd"),
    )


def adapt_graphql(rows: DataFrame, native: str = "ETH") -> DataFrame:
    """SRC-08: transfers of a nested payload, all provisional; the zero address and an empty contract mean the native asset, an amount that is no number is 0."""
    t = read_json(rows.select("payload"), GRAPHQL).select(F.posexplode("data.EVM.Transfers").alias("row", "t")).select("row", "t.Transaction.Hash", "t.Block.Number", "t.Transfer.*").filter(F.trim("Hash") != "")
    contract = F.lower(F.trim(F.coalesce("Currency.SmartContract", F.lit(""))))
    is_native = contract.isin("", "0x", ZERO_ADDRESS)
    decimals = F.coalesce(F.col("Currency.Decimals").try_cast("int"), F.lit(18))
    return t.select(
        F.col("Hash").alias("tx_hash"), F.col("Number").try_cast("bigint").alias("block_height"), F.lower("Sender").alias("src"), F.lower("Receiver").alias("dst"), F.when(is_native, "native").otherwise("erc20").alias("transfer_type"),
        F.when(~is_native, contract).alias("contract"), F.coalesce(F.nullif(F.trim("Currency.Symbol"), F.lit("")), F.when(is_native, native)).alias("symbol"), decimals.alias("decimals"),
        F.coalesce(to_base_units(F.col("Amount"), decimals)["amount"], F.lit("0")).alias("amount"), F.lit("provisional").alias("finality"),
    )


def adapt_confidence(lines: DataFrame) -> DataFrame:
    """SRC-18: id, level of a taxonomy's lines (column value); blank lines, comments and the heading go."""
    parts = F.split(F.trim("value"), ",")
    rows = lines.filter(~F.trim("value").rlike("^(#.*)?$")).select(F.trim(parts[0]).alias("id"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int").alias("level"))
    return rows.filter("id <> '' and level is not null")


def adapt_tagpack(rows: DataFrame, levels: DataFrame, chains: Mapping[str, str]) -> DataFrame:
    """SRC-09: one row per tag with its outcome: ok, unsupported (another currency) or error (no address or label, or a malformed address).

    A tag's field wins over the pack's, that over its header block's. rows: payload, one pack as JSON; levels: id, level
    of the confidence taxonomy, which has a fixed handful of rows. A consumer takes a pack only if none of its tags is an error.
    """
    pack = rows.select(F.monotonically_increasing_id().alias("pack"), F.from_json("payload", TAGPACK).alias("p"))
    tags = pack.select("pack", "p", F.posexplode("p.tags").alias("tag", "t"))
    field = lambda name: F.nullif(F.trim(F.coalesce(F.col(f"t.{name}"), F.col(f"p.{name}"), F.col(f"p.header.{name}"))), F.lit(""))
    r = tags.select("pack", "tag", *(field(x.split()[0]).alias(x.split()[0]) for x in _TAG.split(", ")))
    chain = lookup(chains, F.upper("currency"))
    form, error = canonical_address(chain, F.col("address"))
    outcome = F.when(chain.isNull(), "unsupported").when(F.col("address").isNull() | F.col("label").isNull() | error.isNotNull(), "error").otherwise("ok")
    known = F.broadcast(levels.select(F.col("id").alias("confidence"), (F.col("level") / 100).alias("share")))
    return r.withColumns({"chain": chain, "form": form, "outcome": outcome}).join(known, "confidence", "left").select(
        "pack", "tag", "outcome", "chain", F.when(F.col("outcome") == "ok", F.col("form")).alias("address"), "label", "category", F.col("source").alias("backlink"), F.col("share").alias("confidence"), F.col("confidence").alias("confidence_id"),
        note(F.concat(F.lit("source: "), "source"), F.concat(F.lit("confidence: "), F.col("confidence"))).alias("note"), "abuse", "actor", truthy(F.col("is_cluster_definer")).alias("cluster_definer"),
    )


def adapt_actorpack(rows: DataFrame) -> DataFrame:
    """SRC-10: external_id, name, kind (the first category) of actors; without id or label there is none."""
    a = read_json(rows, ACTORPACK).select(F.explode("actors").alias("a"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return a.select(text(F.col("a.id")).alias("external_id"), text(F.col("a.label")).alias("name"), text(F.try_element_at(F.col("a.categories"), F.lit(1))).alias("kind")).filter("external_id is not null and name is not null")


def adapt_sanctions(rows: DataFrame, chains: Mapping[str, str]) -> DataFrame:
    """SRC-11: one row per digital currency id of sanctions entries with its outcome: ok, unsupported or error.

    rows: payload, one entry element as XML text (what a reader with rowTag sdnEntry splits a list into). An entry that declares a document type is an error of
    its own and is not parsed.
    """
    declared = F.contains("payload", F.lit("<!DOCTYPE"))
    e = rows.select(declared.alias("declared"), F.from_xml(F.when(~declared, F.col("payload")), SDN_ENTRY).alias("e"))
    ids = e.filter("not declared").select("e", F.explode("e.idList.id").alias("i")).filter(F.col("i.idType").startswith(DIGITAL_CURRENCY))
    ticker = F.upper(F.trim(F.substring("i.idType", len(DIGITAL_CURRENCY) + 1, 40)))
    chain = lookup(chains, ticker)
    form, error = canonical_address(chain, F.col("i.idNumber"))
    outcome = F.when(chain.isNull(), "unsupported").when(F.coalesce(F.trim("i.idNumber"), F.lit("")).isin("") | error.isNotNull(), "error").otherwise("ok")
    name = F.coalesce(F.nullif(entity_name(F.trim("e.firstName"), F.trim("e.lastName"), F.initcap(F.trim("e.sdnType"))), F.lit("")), F.trim("e.firstName"), F.lit("(unknown)"))
    programs = F.array_join(F.filter(F.transform(F.coalesce("e.programList.program", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda p: p != ""), ", ")
    found = ids.select(
        F.col("e.uid").alias("uid"), outcome.alias("outcome"), chain.alias("chain"), ticker.alias("ticker"), F.when(outcome == "ok", form).alias("address"), name.alias("entity"), programs.alias("programs"),
        F.concat(F.lit("OFAC SDN: "), name, F.when(programs != "", F.concat(F.lit(" ("), programs, F.lit(")"))).otherwise("")).alias("rationale"),
    )
    return found.unionByName(e.filter("declared").select(F.lit("error").alias("outcome")), allowMissingColumns=True)


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11, read: the entries of landed lists as XML text, for adapt_sanctions. Entries are split by Spark, so a list may be of any length."""
    entries = spark.read.format("text").option("lineSep", "</sdnEntry>").load(path)
    return entries.filter(F.contains("value", F.lit("<sdnEntry"))).select(F.concat(F.regexp_extract("value", r"(?s)(<sdnEntry.*)", 1), F.lit("</sdnEntry>")).alias("payload"))


def adapt_address_intel(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13: entities (address, external_id, name, kind, confidence, method) and attributions (address, label, category, confidence, note).

    A confirmed and a predicted entity stay apart, also where they have one name: without an id the key holds the method.
    """
    r = read_json(rows, ADDRESS_INTEL)

    def entity(field: str, confidence: float, method: str) -> DataFrame:
        e = lambda x: F.col(f"{field}.{x}")
        return r.filter(F.coalesce(e("name"), F.lit("")) != "").select("address", F.coalesce(F.nullif(e("id"), F.lit("")), F.concat_ws(":", F.lit("arkham"), e("name"), F.lit(method))).alias("external_id"), e("name").alias("name"), e("type").alias("kind"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    def claim(test: Column, label: Column, category: Column, confidence: float | None, why: str) -> DataFrame:
        return r.filter(test).select("address", label.alias("label"), category.cast("string").alias("category"), F.lit(confidence).cast("double").alias("confidence"), F.lit(why).alias("note"))

    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    entities = entity("arkhamEntity", CONFIRMED, "arkham-entity").unionByName(entity("predictedEntity", PREDICTED, "arkham-predicted"))
    claims = claim(there("predictedEntity.name"), F.col("predictedEntity.name"), F.col("predictedEntity.type"), PREDICTED, "arkham predicted entity (probabilistic)")
    claims = claims.unionByName(claim(there("arkhamLabel.name"), F.col("arkhamLabel.name"), F.lit(None), CONFIRMED, "arkham label"))
    return entities, claims.unionByName(claim(there("depositServiceID"), F.trim("depositServiceID"), F.lit("deposit_service"), None, "deposit address -> service"))


def adapt_headline_risk(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-14: a headline row (address, score, category, rationale) and a row for each category with a score that is not zero (address, signal, score)."""
    r = read_json(rows, HEADLINE_RISK)
    shown = F.concat_ws("; ", *(F.when(F.coalesce(f"{c}_score", F.lit(0.0)) != 0, F.concat(F.lit(f"{c}="), F.col(f"{c}_score").cast("string"))) for c in RISK_CATEGORIES))
    extras = F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), F.col(c)) for c in ("hop_distance", "is_seed")))
    blank = lambda c: F.nullif(c, F.lit(""))
    headline = r.select("address", F.col("max_score").alias("score"), F.lit("0-100").alias("score_scale"), F.col("greatest_risk_category").alias("category"), note(blank(F.col("risk_level")), blank(shown), blank(extras)).alias("rationale"))
    signals = r.unpivot("address", [f"{c}_score" for c in RISK_CATEGORIES], "signal", "score").filter("score <> 0").withColumn("signal", F.regexp_replace("signal", "_score$", ""))
    return headline, signals


def adapt_vendor_risk(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-15: a headline row on the scale 3-100, its category the risk type of the largest share, and a row for each detail with a type."""
    r = read_json(rows, VENDOR_RISK)
    part = lambda d: F.format_string("%s:%s (%s, hop %s, $%s, %s%%)", *(F.coalesce(d[x].cast("string"), F.lit("None")) for x in ("risk_type", "entity", "exposure_type", "hop_num", "volume", "percent")))
    blank = lambda c: F.nullif(c, F.lit(""))
    details = F.coalesce("risk_detail", F.from_json(F.lit("[]"), "array<struct<entity: string, risk_type: string, exposure_type: string, hop_num: string, volume: string, percent: double>>"))
    most = F.array_max(F.transform(details, lambda d: F.coalesce(d["percent"], F.lit(0.0))))
    first = F.try_element_at(F.filter(details, lambda d: F.coalesce(d["percent"], F.lit(0.0)) == most), F.lit(1))
    why = note(blank(F.col("risk_level")), blank(F.array_join("detail_list", "; ")), F.concat(F.lit("incident: "), blank(F.col("hacking_event"))), blank(F.array_join(F.transform(details, part), " | ")))
    headline = r.select("address", "score", F.lit("3-100").alias("score_scale"), first["risk_type"].alias("category"), why.alias("rationale"))
    signals = r.select("address", F.explode(details).alias("d")).select("address", F.col("d.risk_type").alias("signal"), F.col("d.percent").alias("score")).filter(F.coalesce("signal", F.lit("")) != "")
    return headline, signals


def adapt_vendor_labels(rows: DataFrame) -> DataFrame:
    """SRC-15: the first label is the attribution, the others its note."""
    r = read_json(rows, VENDOR_LABELS).withColumn("labels", F.filter(F.transform("label_list", lambda x: F.trim(x)), lambda x: x != "")).filter(F.size("labels") > 0)
    return r.select("address", F.col("labels")[0].alias("label"), F.nullif(F.trim("label_type"), F.lit("")).alias("category"), F.when(F.size("labels") > 1, F.concat(F.lit("tags: "), F.array_join(F.slice("labels", 2, 1_000_000), ", "))).alias("note"))


def adapt_screening(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-16: a categorical risk for each identification (the source's category, else 'sanctioned'), and every screened address with how many it has."""
    r = read_json(rows, SCREENING)
    n = r.select("address", F.greatest(F.size(F.coalesce("identifications", F.array().cast("array<struct<category: string, name: string, description: string>>"))), F.lit(0)).cast("long").alias("identifications"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    hit = r.select("address", F.explode("identifications").alias("i")).select("address", F.coalesce(blank("i.category"), F.lit("sanctioned")).alias("category"), F.nullif(F.concat_ws(" — ", blank("i.name"), blank("i.description")), F.lit("")).alias("rationale"))
    return hit, n


def manifest_of(files: DataFrame) -> DataFrame:
    """SNK-02: path and SHA-256 digest of every file (path, content), without temporary ones and the manifest itself."""
    return files.filter(~F.col("path").rlike(r"\.tmp$|(^|/)manifest\.json$")).select("path", F.sha2("content", 256).alias("digest"))


def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-02: manifest_of the files below a folder, by their relative paths. Files are read where tasks run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = folder.rstrip("/").split("://")[-1].lstrip("/")
    return manifest_of(files.select(F.regexp_replace("path", f"^.*?{re.escape(inside)}/", "").alias("path"), "content"))


def check_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-04: path, problem of references that are unsafe (absolute, or with a '..' part) or absent. An empty reference is none."""
    asked = references.select("path").filter("path <> ''").distinct()
    unsafe = F.col("path").rlike(r"^[/\\]|(^|/)\.\.(/|$)")
    absent = asked.filter(~unsafe).join(files.select("path").distinct(), "path", "left_anti")
    return asked.filter(unsafe).select("path", F.lit("unsafe").alias("problem")).unionByName(absent.select("path", F.lit("absent").alias("problem")))


def verify_bundle(manifest: DataFrame, files: DataFrame, references: DataFrame, audits: DataFrame) -> DataFrame:
    """SNK-06: part, ok, problems for the manifest, the references and the audits (check, ok) of a bundle; it holds if every part does."""
    count = lambda rows, part: rows.agg(F.count(F.lit(1)).alias("problems")).select(F.lit(part).alias("part"), (F.col("problems") == 0).alias("ok"), "problems")
    return count(verify_manifest(manifest, files), "manifest").unionByName(count(check_references(references, files), "references")).unionByName(count(audits.filter("not ok"), "audits"))
