"""STR-01: incremental, replay-safe ingest of a landing folder: a batch rewrites only the hash buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists, remove

BUCKET = "__bucket"


def ingest(
    spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64, source: str = "json"
) -> None:
    """Merges what is new in the landing folder into the table at target, and returns.

    The table is partitioned by a hash of the natural key into a fixed number of buckets, the same for its whole life. A micro-batch reads only
    the buckets that its keys touch, merges old rows and new ones by `merge` (a pure function of their union, which keeps rows of a key together and
    orders by what rows carry, not by arrival), and replaces just those partitions; all other files stay as they are. A bucket should fit a
    task: give as many buckets as the table has such pieces.

    A batch is first written as a whole beside the checkpoint, then put in place. If the driver is lost in between, the stream replays the batch
    and takes what was written, so half-replaced partitions are never merged again. Replayed files and replayed batches change nothing.
    All folders must be shared. Null key fields are values like any other; an empty landing folder leaves the target as it is.
    """
    names = spark.createDataFrame([], schema).columns

    def write(batch: DataFrame, number: int) -> None:
        session, staged = batch.sparkSession, f"{checkpoint}/staged/{number}"
        if not exists(session, f"{staged}/_SUCCESS"):
            rows = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # no more than there are buckets
            if not touched:
                return
            if exists(session, target):
                rows = stored(session, target, schema).filter(F.col(BUCKET).isin(touched)).unionByName(rows)
            merge(rows).select(*names, BUCKET).write.mode("overwrite").parquet(staged)
        done = session.read.schema(f"{schema}, {BUCKET} int").parquet(staged)
        done.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(target)
        remove(session, f"{checkpoint}/staged/{number - 1}")

    reader = spark.readStream.schema(schema).format(source)
    reader.load(landing).writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The table with its bucket column, by which a filter reads only those folders."""
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(target)
