"""Movements: the unified view, valuation, flows per address, filters and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exact
from ..scratch import table
from .scans import exclusive_scan

def movement_view(transfers: DataFrame, outputs: DataFrame, value: bool = False) -> DataFrame:
    """JON-01: transfers and UTXO outputs in one schema; an output has no source and the chain's own asset.

    value: carry the transfers' column value, null for outputs, so that nothing has to be joined back.
    """
    account = transfers.select(F.lit("transfer").alias("subject_type"), "id", "tx_id", "chain", "src", "dst", "asset", "amount", *(["value"] if value else []))
    utxo = outputs.select(F.lit("tx_output").alias("subject_type"), "id", "tx_id", F.lit("bitcoin").alias("chain"), F.lit(None).cast("string").alias("src"), F.col("address").alias("dst"), F.lit("BTC").alias("asset"), "amount", *([F.lit(None).cast(transfers.schema["value"].dataType).alias("value")] if value else []))
    return account.unionByName(utxo)


def address_flow(movements: DataFrame, values: DataFrame) -> DataFrame:
    """JON-02: what reaches each destination, with its value where a claim gives one."""
    return movements.join(values, ["subject_type", "id"], "left").select("subject_type", "id", F.col("dst").alias("address"), "asset", "amount", "value")


def with_acquiring_source(movements: DataFrame, queries: DataFrame) -> DataFrame:
    """JON-03: movements beside the source query that produced them."""
    return movements.join(queries.select(F.col("id").alias("query_id"), "connector", "capability"), "query_id", "left")


def resolve_spends(inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-04: inputs with the output they spend (null if unknown), and outputs with spent and the least spender."""
    known = outputs.select(F.col("id").alias("prev_output_id"), F.lit(True).alias("known"))
    linked = inputs.join(known, "prev_output_id", "left").select("id", "tx_id", F.when(F.col("known"), F.col("prev_output_id")).alias("prev_output_id"))
    spenders = inputs.groupBy(F.col("prev_output_id").alias("id")).agg(F.min("tx_id").alias("spending_tx_id"))
    return linked, outputs.join(spenders, "id", "left").withColumn("spent", F.col("spending_tx_id").isNotNull())


def unvalued(movements: DataFrame, values: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """JON-05: movements without a valuation by `source`; those of other sources do not count. Limited only if asked."""
    rest = movements.join(values.filter(F.col("source") == source), ["subject_type", "id"], "left_anti")
    return rest.orderBy("subject_type", "id").limit(limit) if limit is not None else rest


def attach_prices(movements: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """JON-06: unit_price by exact (price key, time), cached before fetched, and why a movement has none."""
    keys = ["price_key", "ts"]
    priced = movements.join(cache.withColumnRenamed("price", "cached"), keys, "left").join(fetched.withColumnRenamed("price", "new"), keys, "left")
    price = F.coalesce("cached", "new")
    why = F.when(F.col("ts").isNull(), "no time").when(F.col("price_key").isNull(), "no key").when(price.isNull(), "no price").otherwise("valued")
    return priced.select(*movements.columns, price.alias("unit_price"), why.alias("outcome"))


def address_totals(movements: DataFrame, inputs: DataFrame, native: Column) -> DataFrame:
    """AGG-02: per address, value received and sent and the native amounts; UTXO addresses send by inputs. Zero is null.

    Amounts and values may be numbers or, for whole numbers of any size up to 90 digits, text or exact numbers (functions.exact); numbers come
    back in their own kind, others as text. A movement is read once for both of its ends.
    """
    moved = movements.select("src", "dst", "value", F.when(native, F.col("amount")).alias("amount"))
    spent = inputs.select(F.col("address").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast(movements.schema["value"].dataType).alias("value"), "amount")
    rows = exact.parsed(moved.unionByName(spent), "value", "amount")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("address"), F.lit("in").alias("side")), F.struct(F.col("src").alias("address"), F.lit("out").alias("side"))))
    sides = rows.select(ends.alias("end"), *rows.columns).select("end.*", *rows.columns).filter("address is not null")
    sums = sides.groupBy("address", "side").agg(*(F.nullif(exact.sum_of(sides, c), F.lit("0") if exact.is_exact(sides, c) else F.lit(0).cast("long")).alias(c) for c in ("value", "amount")))
    total = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))  # noqa: E731  of one row
    return sums.groupBy("address").agg(
        total("value", "in").alias("received_value"), total("value", "out").alias("sent_value"), total("amount", "in").alias("received_native"), total("amount", "out").alias("sent_native")
    )


def rollup_parallel(edges: DataFrame, individual: Column) -> DataFrame:
    """AGG-01: edges of one (source, target, asset, kind) as one; single edges and individual ones stay as they are. Which they are: rollup_members.

    Edges without a column kind are of one kind. Amounts and values may be numbers or text of whole numbers, which are summed exactly, or exact numbers, which come back as text.
    """
    key = _edge_key(edges)
    plain = exact.parsed(edges.filter(~individual), "amount", "value_e4")
    grouped = plain.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"), exact.sum_of(plain, "amount").alias("amount"), exact.sum_of(plain, "value_e4").alias("value_e4"),
        F.max(F.when(F.col("finality") == "provisional", "provisional").otherwise("final")).alias("finality"),
        F.count_if(F.col("value_e4").isNull()).alias("no_price"), F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("source_names"),
    )
    alone = edges.filter(individual).select(
        *key, F.lit(1).cast("long").alias("count"), exact.shown(edges, "amount"), exact.shown(edges, "value_e4"), "finality", F.when(F.col("value_e4").isNull(), 1).otherwise(0).cast("long").alias("no_price"),
        F.col("source_name").alias("source_names"),
    )
    return grouped.unionByName(alone)


def rollup_members(edges: DataFrame, individual: Column) -> DataFrame:
    """AGG-01: the edges beneath each rolled-up one, a row each: a pair may have any number of them."""
    return edges.filter(~individual).select(*_edge_key(edges), "id")


def _edge_key(edges: DataFrame) -> list[str]:
    return [c for c in ("source", "target", "asset", "kind") if c in edges.columns]


def clustering_transfers(transfers: DataFrame) -> DataFrame:
    """FLT-14: the transfers that clustering can use: both ends known and an amount that is a whole number, of any size; the amount as text.

    A null end, a null amount or a text that is no whole number (or has more than 90 digits) leaves a row out.
    """
    amount = exact.text(exact.parse(F.col("amount")))
    return transfers.select("id", "src", "dst", "asset", amount.alias("amount"), "block_height").dropna(subset=["src", "dst", "amount"])


def occurrences(transfers: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """WIN-01: the ordinal, from 0, of a movement among those of equal content. One movement may be repeated any number of times."""
    return exclusive_scan(transfers.withColumn("__one", F.lit(1).cast("long")), key, order, {"__one": "occurrence"}).drop("__one")


def merge_transfers(rows: DataFrame, content: list[str]) -> DataFrame:
    """UPS-04: one row per movement that several sources report: content, occurrence, id (the first writer's), writers.

    Each source's reports of equal content are numbered, and the n-th of one source is the n-th of any other: so two equal movements of one
    transaction stay two, and a second report of either adds nothing. content names the columns that make a movement (transaction, type,
    ends, asset, amount); rows also have source and id, by which the first writer is told.
    """
    placed = occurrences(rows, [*content, "source"], ["id"])
    return placed.groupBy(*content, "occurrence").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("writers"))


def representative_value(values: DataFrame) -> DataFrame:
    """WIN-07: the valuation of most confidence per subject, the larger value at ties; contested if it has several."""
    best = F.max_by("value", F.struct(F.coalesce("confidence", F.lit(0.0)), "value"))
    return values.filter("value is not null").groupBy("subject_type", "id").agg(best.alias("value"), (F.count(F.lit(1)) > 1).alias("contested"))


def running(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """WIN-08: half-open intervals [lo, hi) of the running amount of each key, in the kind of the amount.

    Whole numbers in text become exact numbers (functions.exact), which compare as numbers do; exact.text writes them. A null amount
    counts as 0. Ties of the order come in any order. A key of any size is shared out over tasks.
    """
    key = [key] if isinstance(key, str) else key
    if not exact.is_text(rows, "amount"):
        out = exclusive_scan(rows.withColumn("__n", F.coalesce("amount", F.lit(0).cast(rows.schema["amount"].dataType))), key, [order], {"__n": "lo"})
        return out.withColumn("hi", F.col("lo") + F.col("__n")).drop("__n").select(*rows.columns, "lo", "hi")
    own = F.coalesce(exact.parse(F.col("amount")), exact.parse(F.lit("0")))
    limbs = [f"__{i}" for i in range(2 * exact.LIMBS)]
    split = rows.withColumn("__own", own).select("*", *(p.alias(c) for p, c in zip(exact.parts_of(F.col("__own")), limbs)))
    found = exclusive_scan(split, key, [order], {c: f"{c}s" for c in limbs}).withColumn("lo", exact.joined([F.col(f"{c}s") for c in limbs]))
    return found.withColumn("hi", exact.plus(F.col("lo"), F.col("__own"))).select(*rows.columns, "lo", "hi")


def edge_widths(edges: DataFrame, low: float = 1.5, high: float = 8.0) -> DataFrame:
    """WIN-13: a width by the logarithm of the value over all priced edges, or of the amount within an asset."""
    priced = F.col("value_e4") > 0
    size = F.when(priced, F.col("value_e4")).when(F.col("value_e4").isNull() & (F.col("amount") > 0), F.col("amount"))
    group = F.when(priced, F.lit("")).otherwise(F.col("asset"))
    spans = edges.select("id", F.ln(size).alias("x"), group.alias("scale"))
    limits = spans.groupBy("scale").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    t = F.when(F.col("b") > F.col("a"), (F.col("x") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.5)
    return spans.join(limits, "scale").select("id", F.when(F.col("x").isNull(), F.lit(low)).otherwise(F.round(low + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (high - low), 2)).alias("width"))


def capped_counterparties(edges: DataFrame, cap: int) -> DataFrame:
    """WIN-09: counterparties per hub and direction, unpriced before priced, then by size; the first `cap` have a place, the rest are folded.

    The first are found by a limited window, of which a task passes on `cap` rows a hub at most; the rest have no place and are not sorted,
    so a hub with any number of counterparties is no task of its own.
    """
    ends = lambda hub, other, way: edges.select(F.col(hub).alias("hub"), F.lit(way).alias("direction"), F.col(other).alias("other"), "value_e4", "amount")
    sums = ends("target", "source", "in").unionByName(ends("source", "target", "out")).groupBy("hub", "direction", "other").agg(F.sum("value_e4").alias("value_e4"), F.sum("amount").alias("amount"))
    sums = table(sums, "counterparties")
    order = W.partitionBy("hub", "direction").orderBy(F.col("value_e4").isNotNull(), F.desc(F.coalesce("value_e4", "amount")), "other")
    key = ["hub", "direction", "other"]
    first = sums.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= cap).select(*key, "place")
    return sums.join(first, key, "left").withColumn("folded", F.col("place").isNull())


def bounded_pull(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """FLT-04: the first `limit` rows of each key in order, with partial: whether the key has more. One row beyond the limit tells; so tasks
    pass on limit + 1 rows of a key at most, however many it has."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    first = rows.withColumn("__place", place).filter(F.col("__place") <= limit + 1)
    return first.withColumn("partial", F.max("__place").over(W.partitionBy(key)) > limit).filter(F.col("__place") <= limit).drop("__place")


def top_counterparties(transfers: DataFrame, address: str, n: int) -> DataFrame:
    """TOP-04: transfers of an address with one of its n counterparties of most transfers, ties to the lesser name; transfers without a counterparty stay.

    The counterparty is the other end; of a transfer that doesn't touch the address it is the receiver.
    """
    other = F.when(F.col("dst") == address, F.col("src")).when(F.col("src") == address, F.col("dst")).otherwise(F.col("dst"))
    rows = transfers.withColumn("__other", other)
    best = rows.filter("__other is not null").groupBy("__other").count().orderBy(F.desc("count"), "__other").limit(n)
    return rows.join(best, "__other", "left_semi").unionByName(rows.filter("__other is null")).drop("__other")


def next_hops(frontier: DataFrame, transfers: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """JON-11: outgoing transfers of the frontier that the trace does not hold, the first `cap` for each address by size."""
    out = transfers.join(frontier.select(F.col("address").alias("src")).distinct(), "src", "left_semi").join(known.select("id"), "id", "left_anti")
    order = W.partitionBy("src").orderBy(F.desc("amount"), "id")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).drop("place")
