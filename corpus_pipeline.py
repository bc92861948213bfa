"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, line_dedup, near_dedup, packing, secrets, toxicity
from ledgerloom.scratch import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject (score of 0.5 or more) go; the others stay as they are."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity(model, F.col("text"), spark) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document goes only if all its lines went."""
    done = line_dedup.line_dedup(docs)
    return done.filter((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id; of exact repetitions of a row, one.

    A document is an id with a text: of one id with several texts each is judged by its text. Rows without an id stay.
    """
    found = table(near_dedup.near_duplicates(docs).select("doc_id", "text_md5", "kept"), "near-duplicates")
    ident = [F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.lower(F.coalesce("text", F.lit("")))).alias("text_md5")]
    whole = docs.select(*ident, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rest = whole.join(found.filter("not kept").select("doc_id", "text_md5").distinct(), ["doc_id", "text_md5"], "left_anti")
    repeated = table(found.filter("kept and doc_id is not null").groupBy("doc_id", "text_md5").count().filter("count > 1").drop("count"), "repeated-rows")
    if not repeated.isEmpty():
        one = rest.join(repeated, ["doc_id", "text_md5"], "left_semi").dropDuplicates(["doc_id", "text_md5"])
        rest = rest.join(repeated, ["doc_id", "text_md5"], "left_anti").unionByName(one)
    return rest.select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole or in pieces, gets a place in a sequence; lengths are counted in byte-level BPE tokens."""
    import public_tokenizers

    lengths = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack_documents(lengths, length="n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express trained models and sketches; the stages are tested one by one, see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
