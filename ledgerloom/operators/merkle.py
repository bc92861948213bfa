"""Tamper-evident snapshots: a Merkle tree over row digests, and the difference of two snapshots by descending where their trees differ (AUD-09 to AUD-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, table

#: A node's place is the first hex digits of the SHA-256 of its rows' keys, so that a row keeps its place whatever else comes or goes.
FAN_OUT = 16


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's fields; fields are told apart by their lengths, null from empty."""
    def field(c: Column) -> Column:
        said = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))

    return F.sha2(F.concat(*map(field, columns)), 256)


def depth_for(rows: int, leaf: int = 64) -> int:
    """Levels below the root at which a leaf has about `leaf` rows. Trees are compared at one depth: that of the anchored one."""
    depth = 1
    while FAN_OUT**depth * leaf < rows:
        depth += 1
    return depth


def snapshot(rows: DataFrame, key: list[str], columns: list[str], depth: int, path: str | None = None) -> Snapshot:
    """Writes the digests of rows and the tree above them; path: a new folder that all executors share.

    Rows of equal key and content count once, with their number. A leaf hashes its rows in order of (key digest, row digest), an inner node its
    children in order of place, so the root is that of the content whatever the order or layout of rows. Leaves hold rows by a hash of
    their key and so stay small at a fitting depth; every level is one aggregate of at most FAN_OUT digests a node. Null keys are
    values like any other; an empty table has a root alone.
    """
    spark, path = rows.sparkSession, path or new_folder(rows.sparkSession, "snapshot")
    hashed = rows.select(row_digest(*(F.col(c) for c in key)).alias("k"), row_digest(*(F.col(c) for c in columns)).alias("h"), F.struct(*key).alias("key"))
    counted = hashed.groupBy("k", "h").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    counted.withColumn("top", F.substring("k", 1, 2)).repartition("top").write.partitionBy("top").parquet(f"{path}/rows")
    written = spark.read.schema(f"k string, h string, key {counted.schema['key'].dataType.simpleString()}, copies long, top string").parquet(f"{path}/rows")

    def node(children: DataFrame, place: Column, said: Column, level: int) -> DataFrame:
        joined = F.array_join(F.array_sort(F.collect_list(said)), "\n")
        return children.groupBy(place.alias("position")).agg(F.sha2(joined, 256).alias("digest"), F.sum("rows").alias("rows")).withColumn("level", F.lit(level))

    line = F.concat_ws(" ", "k", "h", F.col("copies").cast("string"))
    below = node(written.withColumn("rows", F.col("copies")), F.substring("k", 1, depth), line, depth)
    for level in range(depth, -1, -1):
        below.write.parquet(f"{path}/tree/level={level}")
        below = spark.read.schema("position string, digest string, rows long").parquet(f"{path}/tree/level={level}").withColumn("level", F.lit(level))
        if level:
            below = node(below, F.substring("position", 1, level - 1), F.concat_ws(" ", "position", "digest"), level - 1)
    return Snapshot(spark, path, depth, written)


class Snapshot:
    """The folder of a snapshot: `rows` (k, h, key, copies) and a tree of (level, position, digest, rows)."""

    def __init__(self, spark: SparkSession, path: str, depth: int, rows: DataFrame):
        self.spark, self.path, self.depth, self.rows = spark, path, depth, rows

    def level(self, n: int) -> DataFrame:
        return self.spark.read.schema("position string, digest string, rows long").parquet(f"{self.path}/tree/level={n}")

    def tree(self) -> DataFrame:
        out = self.level(0).withColumn("level", F.lit(0))
        for n in range(1, self.depth + 1):
            out = out.unionByName(self.level(n).withColumn("level", F.lit(n)))
        return out

    def anchor(self) -> DataFrame:
        """AUD-12: digest, rows of the root, one row; of an empty table the digest of nothing."""
        found = self.level(0).agg(F.max("digest").alias("digest"), F.sum("rows").alias("rows"))
        return found.select(F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def differing(before: Snapshot, after: Snapshot) -> DataFrame:
    """position of every leaf in which two snapshots differ, found from the root down: a level is joined only beneath places that differ above."""
    if before.depth != after.depth:
        raise ValueError("snapshots of different depth")
    places = None
    for level in range(before.depth + 1):
        a, b = (s.level(level).select("position", F.col("digest").alias(name)) for s, name in ((before, "a"), (after, "b")))
        if places is not None:
            beneath = places.select(F.col("position").alias("above"))
            a, b = (x.withColumn("above", F.substring("position", 1, level - 1)).join(beneath, "above", "left_semi").drop("above") for x in (a, b))
        places = a.join(b, "position", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("position")
    return places


def changes(before: Snapshot, after: Snapshot) -> DataFrame:
    """AUD-09 to AUD-11: the key's fields and change (added, deleted, modified) of every key whose rows differ.

    Only rows of differing leaves are compared; of the row folders (by the first two digits) only those are read that hold such a leaf: at most
    256 names come to the driver.
    """
    places = table(differing(before, after), "differing-leaves")
    tops = [r[0] for r in places.select(F.substring("position", 1, 2).alias("top")).distinct().collect()]
    folder = F.lit(False)
    for top in tops:
        folder = folder | F.col("top").startswith(top)

    def leaves(s: Snapshot, name: str) -> DataFrame:
        read = s.rows.filter(folder).withColumn("position", F.substring("k", 1, s.depth)).join(places, "position", "left_semi")
        return read.groupBy("k").agg(F.first("key").alias(f"key_{name}"), F.array_sort(F.collect_list(F.struct("h", "copies"))).alias(name))

    both = leaves(before, "a").join(leaves(after, "b"), "k", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").otherwise("modified")
    return both.select(F.coalesce("key_a", "key_b").alias("key"), change.alias("change")).select("key.*", "change")
