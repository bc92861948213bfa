"""Nearest neighbours by stable projections and kd-trees (the SRS method of Sun et al., 2014)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import in_calls, read, table

#: Dimensions of the projection (even), and the confidence of the stopping test.
PROJECTED, CONFIDENCE = 8, 0.95
#: Vectors of a cell and queries searched in it together, about; points in a leaf.
CELL, CHUNK, LEAF = 10_000, 10_000, 64
#: Vectors that the division into cells is fitted on, at most, and how many of them each cell has at least.
SAMPLE, SAMPLED_PER_CELL = 50_000, 20


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number m of degrees of freedom, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


class KdTree:
    """A kd-tree over projected points with bounding boxes; leaves come by growing distance from a query."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[list[int]] = []  # from, to, left child, right child
        self.cuts: list[tuple[int, float]] = []  # coordinate and value that part the children
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            own = points[self.order[start:stop]]
            low.append(own.min(0))
            high.append(own.max(0))
            if parent >= 0:
                self.nodes[parent][2 + side] = len(self.nodes)
            me = len(self.nodes)
            self.nodes.append([start, stop, -1, -1])
            self.cuts.append((0, 0.0))
            if stop - start > leaf:
                middle, axis = (stop - start) // 2, int(np.argmax(high[-1] - low[-1]))
                split = np.argpartition(own[:, axis], middle)
                self.order[start:stop] = self.order[start:stop][split]
                self.cuts[me] = axis, float(own[split[middle], axis])
                todo += [(start, start + middle, me, 0), (start + middle, stop, me, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def leaves(self, query: np.ndarray):
        """(square of the least distance, slice of the tree's order) of every leaf, nearest box first."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        bound = (gap * gap).sum(1)
        heap = [(bound[0], 0)]
        while heap:
            b, i = heapq.heappop(heap)
            start, stop, left, right = self.nodes[i]
            if left < 0:
                yield b, slice(start, stop)
            else:
                heapq.heappush(heap, (bound[left], left))
                heapq.heappush(heap, (bound[right], right))

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The leaf into which each point falls, whether or not the tree was made of it."""
        at = np.zeros(len(points), np.int64)
        nodes, axes, values = np.array(self.nodes), *(np.array(x) for x in zip(*self.cuts))
        while (inner := nodes[at, 2] >= 0).any():
            right = points[np.arange(len(points)), axes[at]] >= values[at]
            at = np.where(inner, np.where(right, nodes[at, 3], nodes[at, 2]), at)
        return at


def directions(dim: int) -> np.ndarray:
    """The stable (Gaussian) projection of vectors of one dimension and of the lifting coordinate behind them."""
    return np.random.default_rng(20140901 + dim).standard_normal((dim + 1, PROJECTED))


def project(vectors: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    """Projections of vectors lifted to the norm of the longest one (squared: most); a query is lifted by 0.

    So inner products become distances: the square of the distance is most + |q|^2 - 2 (q, v).
    """
    lift = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(most - (vectors**2).sum(1), 0))
    d = directions(vectors.shape[1])
    return vectors @ d[:-1] + lift[:, None] * d[-1]


@dataclass
class Search:
    """What one search found: hits per query (best first, ties to the smaller id), and how many leaves it looked at of how many."""

    hits: list[tuple[np.ndarray, np.ndarray]]
    visited: int
    leaves: int


def search(vectors: np.ndarray, members: list[np.ndarray], queries: np.ndarray, k: int, most: float, floors: np.ndarray | None = None) -> Search:
    """For each query, ids and inner products of the k best members that the search finds, if they reach the query's floor.

    Distances shrink by a Gaussian projection: projected over true squared distance follows chi-square with PROJECTED
    degrees of freedom. Leaves are verified by growing projected distance, until a vector nearer than the k-th best
    so far (or the floor) would lie beyond the next leaf with a probability below 1 - CONFIDENCE.
    """
    tree, limit = KdTree(project(vectors, most)), chi_square_quantile(CONFIDENCE, PROJECTED)
    projected = project(queries, most, True)
    vectors, members = vectors[tree.order], [members[i] for i in tree.order]  # a leaf is a slice
    found, visited = [], 0
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    for q, near, floor in zip(queries, projected, floors):
        at, scores, best = [], [], np.full(k, floor)
        base, slack = most + q @ q, 1e-9 * (1 + math.sqrt(most * (q @ q)))
        for bound, leaf in tree.leaves(near):
            if best[0] > -np.inf and bound > limit * max(base - 2 * best[0] + slack, 0.0):
                break
            visited += 1
            s = vectors[leaf] @ q
            if (good := s >= best[0] - slack).any():
                at.append(leaf.start + np.flatnonzero(good))
                scores.append(s[good])
                best = np.sort(np.concatenate([best, s[good]]))[-k:]
        if not at:
            found.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        at, scores = np.concatenate(at), np.concatenate(scores)
        at = at[scores >= best[0] - slack]
        exact = (vectors[at] * q).sum(1)  # the same order of additions for every vector
        ids = np.concatenate([members[i] for i in at])
        exact = np.repeat(exact, [len(members[i]) for i in at])
        order = np.lexsort((ids, -exact))[:k]
        found.append((ids[order], exact[order]))
    return Search(found, visited, (len(tree.nodes) + 1) // 2 * len(queries))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, its k nearest others by inner product.

    Equal vectors are one point that knows its k + 1 smallest ids, which is all any query can need of it. A kd-tree over
    the projections of at most SAMPLE points divides the projected space into cells of about CELL points; every point is
    put into its cell, and cells that turn out larger are dealt into parts. Each part is indexed by a kd-tree of its own
    where it is searched. A query is first searched in its own cell. Its k-th best so far then is a bound: by the same
    stopping test on the cells' boxes, it is searched further only in cells that may hold a nearer vector, and only for
    vectors that reach the bound. How many cells that are depends on the data: few where vectors cluster, all where they
    have no structure at all, and then the work is that of comparing the stated queries with all rows in blocks. A
    task holds one part and CHUNK queries, at any scale. To the driver come the sample and the boxes of the cells,
    which are SAMPLE / SAMPLED_PER_CELL at most.

    Scores are sums in double precision over the stored values; at ties the smaller vec_id comes first. Vectors that are
    null, empty, all zero, or hold a null or non-finite component take no part, nor do null ids; a query is compared
    with vectors of its own dimension. Repeated ids are one query each and candidates of one another's queries only
    under other ids. If there are fewer than k candidates all that are found are returned. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & values.isNotNull()).filter(finite & F.exists(values, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), values.alias("v")).distinct()
    first = W.partitionBy("v").orderBy("id")
    points = table(
        rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("point"), F.size("v").alias("dim")),
        "points",
    )
    queries = table(rows.filter(F.col("id") % every == 0).join(points.select("v", "point"), "v").select("point", F.col("id").alias("query_id")), "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, most = points.agg(F.count(F.lit(1)), F.max(norm)).first()
    hits = _search_cells(spark, points, queries.select("point").distinct(), count, (most or 0.0) * (1 + 1e-12), k + 1)
    best = W.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("point", "vec_id", "score")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(hits, "point").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search_cells(spark: SparkSession, points: DataFrame, asked: DataFrame, count: int, most: float, k: int) -> DataFrame:
    """point, vec_id, score: the hits of the asked points in all cells that they need."""
    sampled = points.select("v").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).toPandas()["v"] if count else []
    dims: dict[int, list] = {}
    for v in sampled:
        dims.setdefault(len(v), []).append(v)
    cells = max(1, min(-(-count // CELL), len(sampled) // SAMPLED_PER_CELL))
    if dims:
        tree = KdTree(np.concatenate([project(np.array(vs), most) for vs in dims.values()]), -(-len(sampled) // cells))
    else:
        tree = KdTree(np.zeros((1, PROJECTED)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                at = project(np.stack(list(own["v"])), most)
                yield own.assign(cell=tree.cell(at), low=list(at))

    dealt = table(points.mapInPandas(placed, f"{', '.join(f'{n} {t}' for n, t in points.dtypes)}, cell long, low array<double>"), "cells")
    sides = [f(F.col("low")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(PROJECTED)]
    boxes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas()
    by_dim = {
        dim: (own["cell"].to_numpy(), own[[f"min{i}" for i in range(PROJECTED)]].to_numpy(), own[[f"max{i}" for i in range(PROJECTED)]].to_numpy(), -(-own["n"].to_numpy() // CELL))
        for dim, own in boxes.groupby("dim")
    }
    parts = {(dim, cell): n for dim, (ids, _, _, ns) in by_dim.items() for cell, n in zip(ids, ns)}
    limit = chi_square_quantile(CONFIDENCE, PROJECTED)

    def routed(floors: bool):
        """Queries with the cells they are searched in: without floors the nearest one, else all others that may hold a better vector."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in in_calls(batch, 1_000):
                    for dim, own in part.groupby("dim"):
                        ids, low, high, numbers = by_dim[dim]
                        vs = np.stack(list(own["v"]))
                        near = project(vs, most, True)
                        gap = np.stack([(np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1) for q in near])
                        home = gap.argmin(1)
                        if floors:
                            room = most + (vs**2).sum(1) - 2 * own["floor"].to_numpy() + 1e-9 * (1 + np.sqrt(most * (vs**2).sum(1)))
                            wanted = gap <= limit * np.maximum(room, 0)[:, None]
                            wanted[np.arange(len(own)), home] = False
                        else:
                            wanted = np.zeros(gap.shape, bool)
                            wanted[np.arange(len(own)), home] = True
                        q, c = np.nonzero(wanted)
                        q, c = np.repeat(q, numbers[c]), np.repeat(c, numbers[c])
                        turn = np.concatenate([np.arange(parts[dim, ids[x]]) for _, x in zip(*np.nonzero(wanted))]) if len(c) else c
                        if len(q):
                            yield pd.DataFrame({"point": own["point"].to_numpy()[q], "v": list(vs[q]), "floor": own["floor"].to_numpy()[q], "dim": dim, "cell": ids[c], "part": turn})

        return route

    def find(key, block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(wanted):
            return pd.DataFrame({"point": pd.Series([], "int64"), "vec_id": pd.Series([], "int64"), "score": pd.Series([], "float64")})
        block, wanted = block.sort_values("point"), wanted.rename(columns=lambda c: c.removeprefix("asked_")).sort_values("point")
        got = search(np.stack(list(block["v"])), list(block["ids"]), np.stack(list(wanted["v"])), k, most, wanted["floor"].to_numpy()).hits
        return pd.DataFrame({"point": np.repeat(wanted["point"].to_numpy(), [len(i) for i, _ in got]), "vec_id": np.concatenate([i for i, _ in got]), "score": np.concatenate([s for _, s in got])})

    sizes = spark.createDataFrame([(int(d), int(c), int(n)) for (d, c), n in parts.items()], "dim int, cell long, parts long")  # a row for each cell
    stored = dealt.join(F.broadcast(sizes), ["dim", "cell"]).select("point", "v", "ids", "dim", "cell", F.pmod(F.xxhash64("point"), F.col("parts")).alias("part"))

    def wave(wanted: DataFrame, floors: bool) -> DataFrame:
        schema = "point long, v array<double>, floor double, dim int, cell long, part long"
        asked_in = table(wanted.mapInPandas(routed(floors), schema), "routed")
        keys = ["dim", "cell", "part"]
        chunks = table(asked_in.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "chunks")
        left = stored.join(chunks, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        right = asked_in.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks"))).drop("chunks")
        renamed = right.toDF(*(f"asked_{c}" for c in right.columns))
        return left.groupBy(*keys, "chunk").cogroup(renamed.groupBy(*(f"asked_{c}" for c in (*keys, "chunk")))).applyInPandas(find, "point long, vec_id long, score double")

    wanted = points.join(asked, "point").select("point", "v", "dim")
    near = table(wave(wanted.withColumn("floor", F.lit(float("-inf"))), False), "hits")
    floors = near.groupBy("point").agg(F.array_sort(F.collect_list("score")).alias("scores")).select("point", F.when(F.size("scores") >= k, F.col("scores")[F.size("scores") - k]).otherwise(float("-inf")).alias("floor"))
    return near.unionByName(wave(wanted.join(floors, "point"), True))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
