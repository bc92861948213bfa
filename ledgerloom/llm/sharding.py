"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import read, table

N_SHARDS = 24


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key, without a ring table: a key leaves its shard only for a shard that was appended.

    Keys are mixed first, so that consecutive ids do not walk the generator in step.
    """
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        shard, ahead = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        while (live := ahead < shards).any():
            shard = np.where(live, ahead, shard)
            x = np.where(live, x * np.uint64(2862933555777941757) + np.uint64(1), x)
            jump = (shard + 1) * (float(1 << 31) / ((x >> np.uint64(33)).astype(np.float64) + 1))
            ahead = np.where(live, np.minimum(jump, 2.0**40).astype(np.int64), ahead)
    return shard


def jump_shard(key, shards: int):
    """Column form of jump_hash; a null key counts as key 0."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    The id and the number of shards alone decide the shard; grown_shard is the shard with one shard more. So equal texts
    (groups) are placed each by its own id and may lie in different shards. Slots number
    the rows of a shard from 0 without gaps, in order of (doc_id, text_crc32, size). They come from a range-partitioned
    sort, so that no shard has to fit a task: each partition numbers its own rows and adds what lies before it, taken
    from a table of one row per (partition, shard) that is no longer than partitions plus shards. The text itself never
    leaves the scan.

    Null texts have size 8 and CRC 0; null ids are keyed as 0; repeated rows get slots of their own; an empty table
    gives an empty result; other columns are ignored.
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    numbered = table(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part.alias("part"), (row - F.shiftleft(part.cast("long"), 33)).alias("row")),
        "shard-rows",
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
        .select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("shift")).alias("slot"), "grown_shard"
    )


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


_JUMP = """{name}(id, x, shard, ahead) AS (SELECT id, x, 0::BIGINT, 0::BIGINT FROM mixed
    UNION ALL SELECT id, y, ahead, least(floor((ahead + 1) * (2147483648::DOUBLE / ((y >> 33)::DOUBLE + 1))), 1099511627776)::BIGINT
      FROM (SELECT *, ((x::UHUGEINT * 2862933555777941757 + 1) % 18446744073709551616)::UBIGINT AS y FROM {name} WHERE ahead < {shards}))"""
_PLACE = "{name}_at AS (SELECT id, max(shard) AS shard FROM {name} GROUP BY id)"

SQL = {
    "op6_jump_sharding": f"""
        WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (
                 SELECT i, list_reduce(list_concat([i], range(8)), lambda k, s: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END) AS v FROM range(256) r(i))),
             docs AS (SELECT row_number() OVER () AS id, doc_id, strlen(coalesce(text, '')) + 8 AS size,
                        xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda s: CAST('0x' || s AS BIGINT))), lambda k, x: xor(k >> 8, t[1 + (xor(k, x) & 255)]))) AS text_crc32
                      FROM documents, crc),
             first AS (SELECT id, ((xor(k, k >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT AS x FROM (SELECT id, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::UBIGINT AS k FROM docs)),
             second AS (SELECT id, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT AS x FROM first),
             mixed AS MATERIALIZED (SELECT id, xor(x, x >> 31) AS x FROM second),
             {_JUMP.format(name="now", shards=N_SHARDS)}, {_PLACE.format(name="now")}, {_JUMP.format(name="grown", shards=N_SHARDS + 1)}, {_PLACE.format(name="grown")}
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, n.shard::INT AS shard, row_number() OVER (PARTITION BY n.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, g.shard::INT AS grown_shard
        FROM docs JOIN now_at n USING (id) JOIN grown_at g USING (id)""",
}
QUERIES = {"op6_jump_sharding": op6_jump_sharding}
