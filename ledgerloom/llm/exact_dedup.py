"""Exact deduplication: a 128-bit content hash groups, the bytes decide, one stable row stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, read


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by their 128-bit MD5 together with their bytes, so that two different texts with one hash are two
    groups. The grouping is a hash aggregate with map-side combine: a text that fills a third of the table leaves one
    row per map task, and each text crosses the network once per map task. Rows find their group again by MD5 and
    SHA-256 alone (48 bytes a row); adaptive execution splits that join where one group is large. Should two different
    texts ever share both hashes, the query fails instead of mixing them.

    keep: "min" keeps the smallest id of a group, "max" the largest. Null texts equal empty ones. Repeated rows (same
    id, same text) count in group_size and are all marked kept. A null id stays only if no row of its group has an id.
    An empty table gives an empty result. Columns other than id and text are ignored.
    """
    chosen = {"min": F.min, "max": F.max}[keep]
    rows = id_text(docs, id_col, text_col).withColumn("h", F.unhex(F.md5("text")))
    groups = (
        rows.groupBy("h", "text")
        .agg(chosen("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("text", 256)).alias("s"), "keep_id", "group_size")
        .groupBy("h", "s")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
    )
    return (
        rows.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("s"))
        .join(groups, ["h", "s"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
