"""AGG-34: an import writes its good rows and counts all others in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: What becomes of a row; ok rows are written.
OUTCOMES = ("ok", "skipped", "failed", "rejected_utxo", "unsupported", "error")


def write_import(classified: DataFrame, path: str, partial: Column | None = None) -> DataFrame:
    """Writes the ok rows of a classified import to path and returns one row of counters: rows, one of each outcome, rounded, truncation_risk, partial.

    classified: outcome, and rounded and truncation_risk of the ok rows, as adapt_transfer_log and classify_explorer_csv give them. The counters are
    observed on the rows as they pass to the writer, so the input is read once, and only the numbers reach the driver. partial: whether a row tells that
    the source was cut short. An outcome that is not known fails the import; an empty import counts zeros.
    """
    seen = Observation("import")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    ok = F.col("outcome") == "ok"
    strange = F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)))
    metrics = [F.count(F.lit(1)).alias("rows"), *(count(F.col("outcome") == o).alias(o) for o in OUTCOMES), count(ok & F.col("rounded")).alias("rounded"), count(ok & F.col("truncation_risk")).alias("truncation_risk"), (count(F.lit(False) if partial is None else partial) > 0).alias("partial"), strange.alias("strange")]
    classified.observe(seen, *metrics).filter(ok).drop("outcome").write.parquet(path)
    found = seen.get
    if found.pop("strange"):
        raise ValueError("an outcome is not known")
    return classified.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'boolean' if k == 'partial' else 'long'}" for k in found))
