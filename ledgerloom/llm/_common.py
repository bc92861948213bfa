"""What the corpus operators share: reading, column selection and the size of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import bucketed, table

__all__ = ["ROWS_PER_CALL", "bucketed", "id_text", "in_calls", "read", "table"]

#: Rows that a Python function works on at once; their arrays must fit a worker, while Spark bounds the batches it sends.
ROWS_PER_CALL = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_calls(batch: pd.DataFrame, rows: int = ROWS_PER_CALL) -> Iterator[pd.DataFrame]:
    """The batch in slices; the session's batch size stays as the user has set it."""
    for i in range(0, len(batch), rows):
        yield batch.iloc[i : i + rows].reset_index(drop=True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
