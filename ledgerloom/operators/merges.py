"""Idempotent merges: each is a pure function of the current version and a batch (UPS-01 to UPS-17, LIF, SET).

Rows carry `seq`, the order of writing. Applying a batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """UPS-04, 07 to 10, 12: the first writer's row of every key stays; null is a value of a key like any other."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def upsert_assets(rows: DataFrame) -> DataFrame:
    """UPS-01: the newest symbol that is there; of decimals the first above 0 sticks, 0 stands for unknown."""
    known = F.col("decimals") > 0
    return rows.groupBy("chain", "contract").agg(
        F.max_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("seq"))).alias("symbol"), F.coalesce(F.min_by("decimals", F.when(known, F.col("seq"))), F.lit(0)).alias("decimals")
    )


def upsert_addresses(rows: DataFrame) -> DataFrame:
    """UPS-02: the latest display form, and the first-seen time that was first known."""
    return rows.groupBy("chain", "address").agg(F.max_by("display", "seq").alias("display"), F.min_by("first_seen", F.when(F.col("first_seen").isNotNull(), F.col("seq"))).alias("first_seen"))


def upsert_transactions(rows: DataFrame) -> DataFrame:
    """UPS-03: rows of one (chain, tx_hash) folded in order of writing.

    Nothing after the first final row counts. Block fields come from the last authoritative row on, where it may set them
    to null and later rows only fill; status from the first row and those that may update it; the query that is cited is
    the last one's.
    """
    key = ["chain", "tx_hash"]
    order = W.partitionBy(*key).orderBy("seq")
    before = F.coalesce(F.max((F.col("finality") == "final").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    live = rows.withColumn("__frozen", before).filter("__frozen = 0").withColumn("__first", F.row_number().over(order) == 1)
    base = F.max(F.when(F.col("authoritative"), F.col("seq"))).over(W.partitionBy(*key))
    live = live.withColumn("__base", F.coalesce(base, F.lit(-(2**62))))
    last = lambda c, when: F.max_by(c, F.when(when & F.col(c).isNotNull(), F.col("seq")))
    current = F.col("seq") >= F.col("__base")
    return live.groupBy(*key).agg(
        last("block_height", current).alias("block_height"), last("block_ts", current).alias("block_ts"), last("fee", F.lit(True)).alias("fee"),
        last("status", F.col("__first") | F.col("update_status")).alias("status"), F.max_by("finality", "seq").alias("finality"), F.max_by("query_id", "seq").alias("query_id"),
    )


def upsert_outputs(rows: DataFrame) -> DataFrame:
    """UPS-05: spent never goes back; the first known spender stays."""
    return rows.groupBy("tx_id", "output_index").agg(F.max("spent").alias("spent"), F.min_by("spending_tx_id", F.when(F.col("spending_tx_id").isNotNull(), F.col("seq"))).alias("spending_tx_id"))


def upsert_inputs(rows: DataFrame) -> DataFrame:
    """UPS-06: the latest previous output and address."""
    return rows.groupBy("tx_id", "input_index").agg(F.max_by("prev_output_id", "seq").alias("prev_output_id"), F.max_by("address", "seq").alias("address"))


def upsert_entities(rows: DataFrame) -> DataFrame:
    """UPS-13: one entity per external id; a real name replaces the stub that equals the id, a type only fills."""
    real = F.when(F.col("name") != F.col("external_id"), F.col("seq"))
    return rows.groupBy("external_id").agg(F.coalesce(F.min_by("name", real), F.col("external_id")).alias("name"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("kind"))


def insert_unless_active(rows: DataFrame, retracted: DataFrame, batch: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """UPS-14: a batch row is added unless an active row has its key; a retracted one does not stand in its way."""
    active = rows.join(retracted.select(id_col), id_col, "left_anti").select(*keys)
    return rows.unionByName(first_rows(batch, keys, id_col).join(active, keys, "left_anti"))


def append(rows: DataFrame, batch: DataFrame) -> DataFrame:
    """UPS-11: claims are only ever added."""
    return rows.unionByName(batch)


def insert_missing(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-16, UPS-17: rows of the batch whose key is not there yet, one for each key."""
    return rows.unionByName(batch.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti"))


def copy_claims(claims: DataFrame, source_ids: DataFrame, target_ids: DataFrame, existing: DataFrame, content: list[str]) -> DataFrame:
    """UPS-15: another case's claims on addresses that this case has, under its ids, unless it has the same content."""
    moved = claims.join(source_ids.select(F.col("id").alias("address_id"), "chain", "address"), "address_id").join(target_ids.select(F.col("id").alias("new_id"), "chain", "address"), ["chain", "address"])
    moved = moved.drop("address_id", "chain", "address").withColumnRenamed("new_id", "address_id")
    known = existing.select(*content).distinct()
    same = [moved[c].eqNullSafe(known[c]) for c in content]
    return moved.join(known, same, "left_anti")


def upgrade_finality(tx: DataFrame, tips: DataFrame) -> DataFrame:
    """LIF-01: confirmations of provisional rows are refreshed; from the chain's threshold on they are final. Final rows stay."""
    joined = tx.join(F.broadcast(tips), "chain", "left")
    n = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("tip") - F.col("block_height") + 1), F.lit(0).cast("long"))
    open_ = F.col("finality") == "provisional"
    return joined.withColumn("confirmations", F.when(open_, n).otherwise(F.col("confirmations"))).withColumn("finality", F.when(open_ & (n >= F.col("threshold")), "final").otherwise(F.col("finality"))).drop("tip", "threshold")


def touching(transfers: DataFrame, inputs: DataFrame, outputs: DataFrame, address: Column) -> DataFrame:
    """SET-01: ids of the transactions that move something from or to an address."""
    parts = [transfers.filter((F.col("src") == address) | (F.col("dst") == address)), inputs.filter(F.col("address") == address), outputs.filter(F.col("address") == address)]
    ids = [p.select("tx_id") for p in parts]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).distinct()


def sweep_reorged(tx: DataFrame, touched: DataFrame, present: DataFrame, referenced: DataFrame) -> DataFrame:
    """LIF-02: provisional transactions of an address that a complete fetch no longer holds, and whether they go or stay as referenced."""
    gone = tx.filter("finality = 'provisional'").join(touched, "tx_id", "left_semi").join(present.select("tx_id"), "tx_id", "left_anti")
    return gone.join(referenced.select("tx_id").distinct().withColumn("kept", F.lit(True)), "tx_id", "left").select("tx_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def refetch_diff(before: DataFrame, after: DataFrame, key: str, signature: Column) -> DataFrame:
    """SET-04: rows that are new, became final, or changed while provisional."""
    old = before.select(key, F.col("finality").alias("old_finality"), signature.alias("old_signature"))
    both = after.withColumn("signature", signature).join(old, key, "left")
    change = F.when(F.col("old_finality").isNull(), "new").when((F.col("old_finality") == "provisional") & (F.col("finality") == "final"), "finalized").when((F.col("finality") == "provisional") & ~F.col("signature").eqNullSafe(F.col("old_signature")), "corrected")
    return both.select(key, change.alias("change")).filter("change is not null")


def judge(rows: DataFrame, kinds: list[str], targets: DataFrame) -> DataFrame:
    """LIF-05: rows with accepted: of an allowed kind, and on a target that exists."""
    known = targets.select("target").distinct().withColumn("found", F.lit(True))
    return rows.join(known, "target", "left").withColumn("accepted", F.col("kind").isin(kinds) & F.coalesce("found", F.lit(False))).drop("found")


def drop_findings(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """LIF-05: notes and references without those of deleted findings."""
    return rows.join(deleted.select("finding").distinct(), "finding", "left_anti")
