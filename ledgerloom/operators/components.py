"""GRF-01: connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or the smaller) neighbours of every node to the least of its neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    linked = near.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that occurs in an edge; component is the least node id of the component.

    Nodes may be of any orderable type. Each round is two joins and four aggregations with map-side combine; the number of
    rounds is logarithmic in the size of a component in practice. A round ends in a table in the shared folder, and the one
    before is removed; only the count and a checksum of the edges come to the driver. Null ends, loops and repeated edges are allowed: a loop gives
    its node a component, an edge with a null end counts as a loop on the other end.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = raw.select(F.col("a").alias("node")).unionByName(raw.select(F.col("b").alias("node"))).filter("node is not null").distinct()
    links = table(raw.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        links, old = table(_star(_star(links, True), False), "stars"), links
        discard(old)
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
