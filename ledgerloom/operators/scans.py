"""Scans along an order within keys, none of which has to fit a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import table


def exclusive_scan(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """Rows with what lies before each of them in its key's order: `sums` maps columns to new columns of their sum (0 at first), `lasts` to new
    columns of their last value that is not null.

    Rows are range-partitioned by key and order. Each partition scans its own rows; what a key brings over from earlier partitions comes
    from one row per partition and key at its two ends, as only such keys cross a border; these few rows, two a partition at most, are
    broadcast, and no other row is shuffled again. So a key of any size is shared out over as many tasks as it needs. Rows that are equal in key and order come in any order.
    """
    sums, lasts = sums or {}, lasts or {}
    part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = table(rows, "scan-rows")  # ranges are drawn from a sample, for which rows would be computed a second time
    placed = table(rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).select("*", part.alias("__part"), row.alias("__row")), "scan")
    here = W.partitionBy("__part", *key).orderBy("__row").rowsBetween(W.unboundedPreceding, -1)
    local = placed.select("*", *(F.sum(c).over(here).alias(n) for c, n in sums.items()), *(F.last(c, ignorenulls=True).over(here).alias(n) for c, n in lasts.items()))
    at_ends = F.array(F.min_by(F.struct(*key), "__row"), F.max_by(F.struct(*key), "__row"))
    ends = placed.groupBy("__part").agg(at_ends.alias("keys")).select(F.col("__part").alias("__end"), F.explode("keys").alias("k")).select("__end", *(F.col(f"k.{k}").alias(f"__end_{i}") for i, k in enumerate(key)))
    at_end = F.col("__part") == F.col("__end")
    for i, k in enumerate(key):
        at_end = at_end & F.col(k).eqNullSafe(F.col(f"__end_{i}"))
    tails = placed.join(F.broadcast(ends), at_end, "left_semi").groupBy("__part", *key).agg(*(F.sum(c).alias(n) for c, n in sums.items()), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__row"))).alias(n) for c, n in lasts.items()))
    earlier = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    brought = tails.select(
        "__part", *key, F.row_number().over(W.partitionBy(*key).orderBy("__part")).alias("__nth"),
        *(F.sum(n).over(earlier).alias(f"__{n}") for n in sums.values()), *(F.last(n, ignorenulls=True).over(earlier).alias(f"__{n}") for n in lasts.values()),
    ).filter("__nth > 1")
    on = F.lit(True)
    for k in ("__part", *key):
        on = on & local[k].eqNullSafe(brought[k])
    both = local.join(F.broadcast(brought), on, "left")
    return both.select(
        *(local[c] for c in rows.columns),
        *((F.coalesce(local[n], F.lit(0)) + F.coalesce(brought[f"__{n}"], F.lit(0))).cast(placed.schema[c].dataType).alias(n) for c, n in sums.items()),
        *(F.coalesce(local[n], brought[f"__{n}"]).alias(n) for n in lasts.values()),
    )


def overlay(cuts: DataFrame, key: list[str]) -> DataFrame:
    """The pieces that two sets of intervals share: key, lo, hi, left, right (the items), for each stretch on which both sides have an item.

    cuts: key, pos, left, right, where one of left and right is a struct (its field id null where an interval ends without a successor), the
    other null. Within a side intervals don't overlap; one that begins where another ends needs no end of its own. A sweep in order of pos carries
    the last item of both sides, so work grows with the cuts, not with pairs of intervals.
    """
    ends = F.coalesce("left", "right")["id"].isNull().cast("int")
    swept = exclusive_scan(cuts.select(*key, "pos", (1 - ends).alias("__kind"), "left", "right"), key, ["pos", "__kind"], lasts={"left": "__left", "right": "__right", "pos": "lo"})
    both = F.col("__left.id").isNotNull() & F.col("__right.id").isNotNull()
    return swept.filter((F.col("lo") < F.col("pos")) & both).select(*key, "lo", F.col("pos").alias("hi"), F.col("__left").alias("left"), F.col("__right").alias("right"))
