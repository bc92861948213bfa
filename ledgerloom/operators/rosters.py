"""Rosters, disagreements and audits over claims, queries and graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import short
from ..scratch import table


def latest_per_source(claims: DataFrame, subject: str = "subject") -> DataFrame:
    """WIN-04: each source's last claim on a subject, by (time, id)."""
    value = F.struct(*(c for c in claims.columns if c not in (subject, "source")))
    return claims.groupBy(subject, "source").agg(F.max_by(value, F.struct("retrieved_at", "id")).alias("v")).select(subject, "source", "v.*")


def disagreements(claims: DataFrame, fields: list[str], subject: str = "subject") -> DataFrame:
    """AGG-20 to 22: subjects on which two sources or more differ in a field; a null is a value of its own."""
    last = latest_per_source(claims, subject)
    differs = [(F.countDistinct(f) + F.max(F.col(f).isNull().cast("int")) > 1).alias(f"{f}_differs") for f in fields]
    found = last.groupBy(subject).agg(F.countDistinct("source").alias("sources"), *differs)
    any_ = F.lit(False)
    for f in fields:
        any_ = any_ | F.col(f"{f}_differs")
    return found.filter((F.col("sources") >= 2) & any_)


def address_flags(risks: DataFrame, attributions: DataFrame) -> DataFrame:
    """AGG-03: sanctioned beats elevated; distinct sources in order."""
    level = F.max(F.when(F.col("category") == "sanctioned", "sanctioned").otherwise("elevated"))
    risk = risks.groupBy("address").agg(level.alias("risk"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("risk_sources"))
    named = attributions.groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("attribution_sources"))
    return risk.join(named, "address", "full_outer")


def counterparties(edges: DataFrame, node: Column, most: int) -> DataFrame:
    """AGG-04: per other end of a node, values and counts in and out, the largest first."""
    into = edges.filter(F.col("target") == node).select(F.col("source").alias("other"), F.lit("in").alias("way"), "value_e4")
    out = edges.filter(F.col("source") == node).select(F.col("target").alias("other"), F.lit("out").alias("way"), "value_e4")
    side = lambda w: F.col("way") == w
    total = lambda w: F.coalesce(F.sum(F.when(side(w), F.col("value_e4"))), F.lit(0)).cast("long")
    g = into.unionByName(out).groupBy("other").agg(total("in").alias("value_in"), total("out").alias("value_out"), F.count_if(side("in")).alias("n_in"), F.count_if(side("out")).alias("n_out"))
    return g.orderBy(F.desc(F.col("value_in") + F.col("value_out")), F.desc(F.col("n_in") + F.col("n_out")), "other").limit(most)


def dust_buckets(edges: DataFrame, dust: Column, by_asset: bool = False) -> DataFrame:
    """AGG-05, AGG-06: what is folded at each hub and direction: distinct counterparties, value, unpriced edges."""
    folded = edges.filter(dust)
    ends = lambda hub, other, way: folded.select(F.col(hub).alias("hub"), F.lit(way).alias("direction"), F.col(other).alias("other"), "value_e4", "asset")
    keys = ["hub", "direction", "asset"] if by_asset else ["hub", "direction"]
    return ends("target", "source", "in").unionByName(ends("source", "target", "out")).groupBy(*keys).agg(
        F.countDistinct("other").alias("counterparties"), F.coalesce(F.sum("value_e4"), F.lit(0)).cast("long").alias("value_e4"), F.count_if(F.col("value_e4").isNull()).alias("no_price")
    )


def produced_by_query(tables: list[DataFrame], queries: DataFrame) -> DataFrame:
    """AGG-15, AGG-16: every query and how many rows cite it, none included."""
    rows = tables[0].select("query_id")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("query_id"))
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select(F.col("id").alias("query_id"), "connector").join(n, "query_id", "left").select("query_id", "connector", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_subgraph(edges: DataFrame, most: int) -> DataFrame:
    """TOP-01: the edges among the `most` nodes of highest degree, ties to the smaller id."""
    degree = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = degree.orderBy(F.desc("degree"), "node").limit(most).select("node")
    inside = edges.join(F.broadcast(top.select(F.col("node").alias("source"))), "source", "left_semi")
    return inside.join(F.broadcast(top.select(F.col("node").alias("target"))), "target", "left_semi")


def poisoning(transfers: DataFrame, key: Column) -> DataFrame:
    """GRF-23: zero-value transfers with an end that never moved value and looks like a real partner of the other end.

    transfers: id, src, dst, amount; key gives the look-alike key of a column `address`. The source end is tested first;
    among several mimicked addresses the smallest is named.
    """
    ends = transfers.select(F.col("src").alias("address"), "amount").unionByName(transfers.select(F.col("dst").alias("address"), "amount"))
    keyed = ends.groupBy("address").agg(F.max("amount").alias("most")).withColumn("key", key)
    real = transfers.filter("amount > 0")
    partners = real.select(F.col("src").alias("victim"), F.col("dst").alias("real")).unionByName(real.select(F.col("dst").alias("victim"), F.col("src").alias("real"))).distinct()
    partners = partners.join(keyed.select(F.col("address").alias("real"), "key"), "real").filter("key is not null")
    zero = transfers.filter("amount = 0")
    tests = zero.select("id", F.lit(1).alias("turn"), F.col("src").alias("look"), F.col("dst").alias("victim")).unionByName(zero.select("id", F.lit(2).alias("turn"), F.col("dst").alias("look"), F.col("src").alias("victim")))
    idle = keyed.filter("most = 0 and key is not null").select(F.col("address").alias("look"), "key")
    hits = tests.join(idle, "look").join(partners, ["victim", "key"]).filter("real <> look")
    return hits.groupBy("id").agg(F.min(F.struct("turn", "real", "look")).alias("m")).select("id", F.col("m.look").alias("lookalike"), F.col("m.real").alias("mimics"))


def missing_keys(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """AUD-01 to AUD-03, SNK-05: rows whose reference is null or leads nowhere."""
    known = targets.select(F.col(target_key).alias(key)).distinct()
    return rows.join(known, key, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AUD-04: rows and distinct natural keys of one table, and whether they agree; catalogue.natural_keys judges all declared tables."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).withColumn("ok", F.col("rows") == F.col("keys"))


def revealed(edges: DataFrame, cap: int) -> DataFrame:
    """TOP-05: hub, other, revealed: the counterparties of each hub, of which the first `cap` by amount, then by name, are shown and the others remain.

    The first are found by a limited window, of which a task passes on `cap` rows a hub at most.
    """
    sums = table(edges.groupBy(F.col("target").alias("hub"), F.col("source").alias("other")).agg(F.sum("amount").alias("amount")), "counterparties")
    first = sums.withColumn("place", F.row_number().over(W.partitionBy("hub").orderBy(F.desc("amount"), "other"))).filter(F.col("place") <= cap).select("hub", "other", F.lit(True).alias("shown"))
    return sums.join(first, ["hub", "other"], "left").select("hub", "other", F.coalesce("shown", F.lit(False)).alias("revealed"))


def delisted(known: DataFrame, current: DataFrame, editions: DataFrame, edition: Column) -> DataFrame:
    """JON-17: chain, address that were listed before and are not in the current edition; none at all if a newer edition than this was read already, as an
    older list tells nothing. editions: published, dates of those read before (null where unknown); an edition without a date counts as current."""
    newest = editions.agg(F.max("published").alias("newest"))
    gone = known.select("chain", "address").distinct().join(current.select("chain", "address"), ["chain", "address"], "left_anti")
    return gone.join(newest).filter(F.coalesce(F.col("newest") <= edition, F.lit(True))).select("chain", "address")  # one row


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """AUD-09 to AUD-11: rows of a baseline (key, hash) that were deleted or rewritten since."""
    now = after.select(key, F.col("hash").alias("new_hash"))
    change = F.when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") != F.col("hash"), "modified")
    return before.select(key, "hash").join(now, key, "left").select(key, change.alias("change")).filter("change is not null")


def numbered(rows: DataFrame, order: list[str], name: str = "place", within: list[str] | None = None) -> DataFrame:
    """TOP-06, WIN-06, WIN-10: rows with their place (from 1) in the order of the given columns, in each group if `within` is given.

    A range-partitioned sort numbers each partition's rows; what lies before a partition comes from a table of one row
    per partition, and a group's start from an aggregate. So no task sorts the whole table or a whole group. Ties in all
    columns are the same row repeated.
    """
    order = [*(within or []), *(c for c in order if c not in (within or []))]
    part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    placed = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("__part"), (row - F.shiftleft(part.cast("long"), 33)).alias("__row")), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = sizes.select("__part", (F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"))
    out = placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__row") + F.col("shift") + 1).drop("__part", "__row", "shift")
    if within:
        starts = out.groupBy(*within).agg(F.min(name).alias("__start"))
        out = out.join(starts, within).withColumn(name, F.col(name) - F.col("__start") + 1)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), name)


def valuations_by_source(values: DataFrame) -> DataFrame:
    """AGG-19: movement, source, claims, least, most, contested of valuations (id, value, source)."""
    one = values.groupBy("id", "source").agg(F.count(F.lit(1)).alias("claims"), F.min("value").alias("least"), F.max("value").alias("most"))
    many = one.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("contested"))
    return one.join(many, "id").withColumnRenamed("id", "movement")


def glossary(evidence: dict[str, DataFrame]) -> DataFrame:
    """AGG-27: term, listed: a term is listed if its evidence has a row. One existence probe each, which stops at the first row."""
    found = [rows.select(F.lit(term).alias("term")).limit(1) for term, rows in evidence.items()]
    hit = found[0]
    for f in found[1:]:
        hit = hit.unionByName(f)
    terms = hit.sparkSession.createDataFrame([(t,) for t in evidence], "term string")
    return terms.join(hit.withColumn("listed", F.lit(True)), "term", "left").select("term", F.coalesce("listed", F.lit(False)).alias("listed"))


def display(references: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """JON-18: references (kind, id) with the label of their target and its node; labels: id, label by kind. A target without a label shows its id."""
    parts = [rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "label") for kind, rows in labels.items()]
    known = parts[0]
    for k in parts[1:]:
        known = known.unionByName(k)
    named = references.join(known.groupBy("kind", "id").agg(F.min("label").alias("label")), ["kind", "id"], "left")
    alias = short(F.col("id"))
    plain = F.when(F.col("kind").isin("tx_output", "transfer"), F.concat(F.when(F.col("kind") == "tx_output", "output ").otherwise("transfer "), alias)).when(F.col("kind") == "entity", F.concat(F.lit("entity "), alias)).otherwise(F.col("id"))
    node = F.when(F.col("kind") == "address", F.concat(F.lit("addr:"), "id")).when(F.col("kind") == "transaction", F.concat(F.lit("tx:"), "id"))
    return named.withColumn("label", F.coalesce("label", plain)).withColumn("node", node)


def run_audits(checks: dict[str, DataFrame], sample: int = 20) -> DataFrame:
    """AUD-13: check, ok, offending (rows) and a sample of ids, by name. Each check has a column id."""
    rows = [c.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("id")) for name, c in checks.items()]
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    first = found.withColumn("place", F.row_number().over(W.partitionBy("check").orderBy("id"))).filter(F.col("place") <= sample)
    ids = first.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))
    n = found.groupBy("check").agg(F.count(F.lit(1)).alias("offending"))
    names = found.sparkSession.createDataFrame([(k,) for k in sorted(checks)], "check string")
    return names.join(n, "check", "left").join(ids, "check", "left").select("check", F.col("offending").isNull().alias("ok"), F.coalesce("offending", F.lit(0)).cast("long").alias("offending"), F.coalesce("sample", F.lit("")).alias("sample"))
