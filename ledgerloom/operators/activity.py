"""SET-02: what happened to a case, from all of its tables, as one log."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip


@dataclass(frozen=True)
class Happening:
    """Rows of a table as events: kind, time, a summary with {columns} in it, and a column that is shown clipped."""

    table: str
    kind: str
    time: str
    summary: str
    detail: str | None = None
    suffix: str | None = None


#: The sources of events; kinds and wording are fixed values.
HAPPENINGS = (
    Happening("source_query", "fetch", "requested_at", "Fetched {connector} · {capability}", "endpoint", "status"),
    Happening("trace", "trace", "created_at", "Trace created: {name}"),
    Happening("finding", "finding", "created_at", "Finding recorded", "statement"),
    Happening("annotation", "annotation", "created_at", "Annotation added to {target_type}"),
    Happening("tag", "tag", "created_at", "Tag '{label}' added to {target_type}"),
    Happening("trace_transfer_retraction", "trace_edit", "created_at", "Trace transfer link retracted"),
    Happening("trace_btc_link_retraction", "trace_edit", "created_at", "Trace BTC link retracted"),
    Happening("trace_bridge_link", "bridge_link", "created_at", "Cross-chain bridge link added"),
    Happening("exhibit", "exhibit", "captured_at", "Exhibit captured ({exhibit_type})", "description"),
    Happening("report", "report", "generated_at", "Report generated: {title}"),
)


def _said(template: str) -> Column:
    parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("None")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def activity_timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """ts, kind, summary, ref_type, ref_id, detail of everything that happened to a case, ordered by (ts, kind, ref_id), rows without a time first.

    tables: any of those that HAPPENINGS names, with id, and trace_retraction (trace_id), which hides traces that were withdrawn. A query whose status
    isn't ok says so. Null fields of a summary read None; details are trimmed, clipped to 80 characters, and null if empty. Tables are read once each
    and put in order by one range-partitioned sort.
    """
    if strange := sorted(set(tables) - {h.table for h in HAPPENINGS} - {"trace_retraction"}):
        raise ValueError(f"nothing happens in {strange}")
    parts = []
    for h in (h for h in HAPPENINGS if h.table in tables):
        rows = tables[h.table]
        if h.table == "trace" and "trace_retraction" in tables:
            rows = rows.join(tables["trace_retraction"].select(F.col("trace_id").alias("id")), "id", "left_anti")
        summary = _said(h.summary)
        if h.suffix:
            odd = F.coalesce(F.col(h.suffix), F.lit("")).isin("", "ok")
            summary = F.concat(summary, F.when(odd, "").otherwise(F.concat(F.lit(" · "), F.col(h.suffix))))
        detail = clip(F.col(h.detail), 80) if h.detail else F.lit(None).cast("string")
        parts.append(rows.select(F.col(h.time).alias("ts"), F.lit(h.kind).alias("kind"), summary.alias("summary"), F.lit(h.table).alias("ref_type"), F.col("id").cast("string").alias("ref_id"), detail.alias("detail")))
    return reduce(DataFrame.unionByName, parts).orderBy("ts", "kind", "ref_id", "ref_type")
