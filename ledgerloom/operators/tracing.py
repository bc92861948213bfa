"""Fund tracing: FIFO apportionment of inputs to outputs, its conservation, taint along its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..scratch import table
from .movements import running
from .scans import overlay


def fifo_intervals(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """TRC-01, JON-16: tx_id, source_id, dest_id, amount, source_at, dest_at: the stretches of each transaction's line that an input and an
    output share, and where they begin within both.

    Inputs and outputs lie on the line by their running amounts. A sweep over the starts of both sides cuts it where either changes
    (scans.overlay): work and rows grow with inputs plus outputs, never with their product, and a transaction of any size is shared out over
    tasks. Amounts are numbers, or text of whole numbers of up to 90 digits; the three measures are then exact numbers. Empty amounts
    take no part.
    """
    side = lambda rows, own, place, first: rows.select("tx_id", F.lit(first).alias("side"), F.col(place).cast("long").alias("__place"), F.col(own).alias("__id"), "amount")
    items = running(side(inputs, "id", "input_index", 0).unionByName(side(outputs, "id", "output_index", 1)), ["tx_id", "side"], "__place")
    full = exact.parse(F.col("amount")) > exact.parse(F.lit("0")) if exact.is_text(inputs, "amount") else F.col("hi") > F.col("lo")  # the bounds of amounts in text are dear, and a filter computes them anew
    items = table(items.filter(full).drop("amount"), "fifo-items")  # read twice below
    begins = items.select("tx_id", "side", F.col("lo").alias("pos"), F.struct(F.col("__id").alias("id"), F.col("lo").alias("start")).alias("item"))
    none = F.struct(F.lit(None).cast(items.schema["__id"].dataType).alias("id"), F.lit(None).cast(items.schema["lo"].dataType).alias("start"))
    ends = items.groupBy("tx_id", "side").agg(F.max("hi").alias("pos")).withColumn("item", none)
    of = lambda which, name: F.when(F.col("side") == which, F.col("item")).alias(name)
    pieces = overlay(begins.unionByName(ends).select("tx_id", "pos", of(0, "left"), of(1, "right")), ["tx_id"])
    minus = exact.minus if exact.is_text(inputs, "amount") else lambda x, y: x - y
    return pieces.select(
        "tx_id", F.col("left.id").alias("source_id"), F.col("right.id").alias("dest_id"), minus(F.col("hi"), F.col("lo")).alias("amount"),
        minus(F.col("lo"), F.col("left.start")).alias("source_at"), minus(F.col("lo"), F.col("right.start")).alias("dest_at"),
    )


def fifo_apportion(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """TRC-01: tx_id, source_id, dest_id, amount for all transactions at once: the lengths of fifo_intervals.

    What outputs do not cover is the fee; outputs beyond the inputs stay without a link. Amounts in text give amounts in text.
    """
    size = exact.text(F.col("amount")) if exact.is_text(inputs, "amount") else F.col("amount")
    return fifo_intervals(inputs, outputs).select("tx_id", "source_id", "dest_id", size.alias("amount"))


def trace_transactions(inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TRC-02: links between outputs (the source is the output that an input spends), and per transaction the inputs whose output is unknown."""
    known = inputs.join(outputs.select(F.col("id").alias("prev_output_id")), "prev_output_id", "left_semi")
    missing = inputs.join(outputs.select(F.col("id").alias("prev_output_id")), "prev_output_id", "left_anti").groupBy("tx_id").agg(F.count(F.lit(1)).alias("unresolved"))
    links = fifo_apportion(known.select("tx_id", F.col("prev_output_id").alias("id"), "input_index", "amount"), outputs)
    return links, missing


def taint(pieces: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """TRC-03: which units of each output come from the starting ones: output_id, lo, hi, hop for up to `hops` transactions on.

    pieces: what fifo_intervals gives for outputs as sources; start: output_id, amount, tainted as a whole. Taint is a set of stretches [lo, hi) within an
    output. A hop cuts them by the pieces of the output that is spent and shifts each part to its place in the next output, so every unit
    is followed, none is split or rounded, and what falls to no output is the fee (taint_balance). Stretches of one output and hop
    are disjoint. Both sets are swept, not joined as pairs, so an output with many pieces and stretches costs their sum.
    """
    front = start.select("output_id", F.lit(0).cast("long").alias("lo"), F.col("amount").cast("long").alias("hi"), F.lit(0).alias("hop")).filter("hi > lo")
    levels = [front]
    where = pieces.select(F.col("source_id").alias("output_id"), F.col("source_at").alias("lo"), (F.col("source_at") + F.col("amount")).alias("hi"), F.struct(F.col("dest_id").alias("id"), (F.col("dest_at") - F.col("source_at")).alias("shift")).alias("item"))
    for hop in range(1, hops + 1):
        tainted = front.select("output_id", "lo", "hi", F.struct(F.col("output_id").alias("id"), F.lit(0).cast("long").alias("shift")).alias("item"))
        reached = where.join(front.select("output_id").distinct(), "output_id", "left_semi")
        cuts = [
            rows.select("output_id", F.col(at).alias("pos"), *(F.when(F.lit(mine), item).alias(name) for name, mine in (("left", left), ("right", not left))))
            for rows, left in ((reached, True), (tainted, False))
            for at, item in (("lo", F.col("item")), ("hi", F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("shift"))))
        ]
        moved = overlay(cuts[0].unionByName(cuts[1]).unionByName(cuts[2]).unionByName(cuts[3]), ["output_id"])
        shift = F.col("left.shift")
        front = table(moved.select(F.col("left.id").alias("output_id"), (F.col("lo") + shift).alias("lo"), (F.col("hi") + shift).alias("hi"), F.lit(hop).alias("hop")), "taint")
        levels.append(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def taint_balance(stretches: DataFrame, inputs: DataFrame) -> DataFrame:
    """TRC-03: hop, units, moved, fee, resting: what taint does with its units: units = moved (tainted at the next hop) + fee + resting (in outputs that no
    input, by prev_output_id, spends). The last hop has nothing moved and its spent units are open, not fee."""
    spent = inputs.select(F.col("prev_output_id").alias("output_id"), F.lit(True).alias("spent")).distinct()
    size = F.col("hi") - F.col("lo")
    units = stretches.join(spent, "output_id", "left").groupBy("hop").agg(F.sum(size).alias("units"), F.coalesce(F.sum(F.when(F.col("spent"), size)), F.lit(0)).alias("spent"))
    moved = stretches.filter("hop > 0").groupBy((F.col("hop") - 1).alias("hop")).agg(F.sum(size).alias("moved"))
    out = units.join(moved, "hop", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    last = stretches.agg(F.max("hop").alias("last"))
    return out.join(F.broadcast(last)).select("hop", "units", "moved", F.when(F.col("hop") < F.col("last"), F.col("spent") - F.col("moved")).alias("fee"), (F.col("units") - F.col("spent")).alias("resting"))


def conservation(links: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """AUD-14: inputs that are overspent and outputs that are overfunded by the links; none if all is well."""
    spent = links.groupBy(F.col("source_id").alias("id")).agg(F.sum("amount").alias("linked")).join(inputs.select("id", "amount"), "id").select(F.lit("input").alias("side"), "id", "linked", "amount")
    got = links.groupBy(F.col("dest_id").alias("id")).agg(F.sum("amount").alias("linked")).join(outputs.select("id", "amount"), "id").select(F.lit("output").alias("side"), "id", "linked", "amount")
    return spent.unionByName(got).filter("linked > amount")


def effective(rows: DataFrame, retractions: DataFrame, key: str) -> DataFrame:
    """JON-07: rows that were not retracted."""
    return rows.join(retractions.select(key).distinct(), key, "left_anti")


def retract(rows: DataFrame, retractions: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """TRC-05: the retractions after a request; known ids once each, unknown ones are refused, a second request changes nothing."""
    new = asked.select(key).distinct().join(rows.select(key), key, "left_semi").join(retractions.select(key), key, "left_anti")
    return retractions.select(key).unionByName(new)


def bridge_links(asked: DataFrame, movements: DataFrame) -> DataFrame:
    """JON-15: source_id, dest_id, source_chain, dest_chain of the asked links (source_id, dest_id) whose ends are movements of two different
    chains; links within a chain, or of an end that is no movement, are rejected."""
    end = lambda side: movements.select(F.col("id").alias(f"{side}_id"), F.col("chain").alias(f"{side}_chain"))
    return asked.join(end("source"), "source_id").join(end("dest"), "dest_id").filter("source_chain <> dest_chain").select("source_id", "dest_id", "source_chain", "dest_chain")
