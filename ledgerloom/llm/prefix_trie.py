"""Prefix trie of conversations: nodes roll up inside bands of fixed height, then completed band roots are carried from band to band."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rosters import numbered
from ._common import read, table

KEY = ["depth", "a", "b"]
#: Members that one chunk of a node's member list holds.
CHUNK = 4096


def _halves(digest: Column) -> list[Column]:
    """The first 128 bits of a hex digest as two signed 64-bit numbers."""
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "a"), (17, "b"))]


def turn_items(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b (128 bits of the turn's SHA-256), bytes (of its text): turns in order, without their texts.

    The order is that of turn, null first; ties are ordered by their digest, and equal rows are turns of their own. Null roles and texts
    count as empty. Rows without a conv_id belong to no conversation. Only digests are sorted; a text never leaves the scan, and
    one conversation may fill many partitions.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"), digest.alias("h"))
    placed = numbered(rows.select("conv_id", "turn", *_halves(F.col("h")), "bytes"), ["turn", "a", "b"], "place", within=["conv_id"])
    return table(placed.select("conv_id", F.col("place").cast("long").alias("place"), "a", "b", "bytes"), "turn-items")


def rebuilt(items: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, bytes: conversation c opens with the first h turns of conversation c - c % 5 (all if fewer, none if absent)
    and goes on with its own turns after its first h, if any; h = crc32(decimal c) % 9. The remainder has the sign of c."""
    c = F.col("conv_id")
    sizes = items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.select("conv_id", (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))
    head = plan.join(items.filter("place <= 8").withColumnRenamed("conv_id", "base"), "base").filter("place <= h")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = plan.join(base, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m"))
    tail = items.join(shift, "conv_id").filter("place > h")
    return head.select("conv_id", F.col("place").alias("depth"), "a", "b", "bytes").unionByName(tail.select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "a", "b", "bytes"))


def _keyed(items: DataFrame, height: int) -> DataFrame:
    """Each (conversation, depth) with its node's key (a, b), its parent's key (pa, pb), the turn's own bits (x, y), and path: the keys of the
    node's ancestors within its band, itself last.

    A key is the exclusive or of the digests of (depth, turn) up to here. It is summed within bands first and then over a conversation's
    bands, so that no window holds more rows than a band is high or a conversation has bands.
    """
    digest = F.sha2(F.concat_ws(":", "depth", "a", "b"), 256)
    rows = items.select("conv_id", "depth", "bytes", F.floor(F.col("depth") / height).alias("band"), digest.alias("h")).select("conv_id", "depth", "bytes", "band", *(c.alias(n) for c, n in zip(_halves(F.col("h")), ("x", "y"))))
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    bands = rows.groupBy("conv_id", "band").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    starts = bands.select("conv_id", "band", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).cast("long").alias(c) for c in ("sx", "sy")))
    here = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    keyed = rows.join(starts, ["conv_id", "band"]).select("*", *(F.bit_xor(c).over(here).bitwiseXOR(F.col(s)).alias(n) for c, s, n in (("x", "sx", "a"), ("y", "sy", "b"))))
    path = F.collect_list(F.struct("a", "b")).over(here)
    root = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return keyed.select(
        "conv_id", "depth", "band", "bytes", "x", "y", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"),
        F.when(F.col("band") == 0, F.concat(root, path)).otherwise(path).alias("path"),
    )


def _member_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 by node of (node, conv_id): SHA-256 of the members' decimal ids, ascending, joined by commas.

    Sorted partitions of bounded size write the list in chunks; one pass then feeds a node's chunks in order to its hash, so
    that memory is that of a chunk, whatever the number of members.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) == CHUNK:
                    out += [(*node, ids[0], ",".join(map(str, ids)))] if ids else []
                    node, ids = key, []
                ids.append(conv)
            yield _batch(out, chunk_fields)
        yield _batch([(*node, ids[0], ",".join(map(str, ids)))] if ids else [], chunk_fields)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    out += [(*node, state.hexdigest())] if state else []
                    node, state = key, hashlib.sha256(ids.encode())
            yield _batch(out, digest_fields)
        yield _batch([(*node, state.hexdigest())] if state else [], digest_fields)

    key_fields = [(c, pa.int64()) for c in KEY]
    chunk_fields, digest_fields = pa.schema([*key_fields, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*key_fields, ("ends_sha256", pa.string())])
    order = [*KEY, "conv_id"]
    listed = ends.select(*(F.col(c).cast("long").alias(c) for c in order)).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "depth long, a long, b long, "
    found = listed.mapInArrow(chunks, kinds + "first long, ids string").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return found.mapInArrow(digests, kinds + "ends_sha256 string")


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=fields)


def prefix_trie(items: DataFrame, members: DataFrame, band_height: int | None = None) -> DataFrame:
    """The trie of sequences: one row per distinct prefix, the root (depth 0, no turn) included.

    items: conv_id, depth (from 1, gapless), a, b (the turn's digest), bytes; members: conv_id of every sequence, those without turns included.
    Returns depth, conv_id (the smallest member), parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's key a, b. Members are the sequences that start with a prefix; n_leaves and saved_tokens cover the subtree, the node included:
    childless nodes, and (n_convs - 1) times the bytes of a node's last text. ends_sha256 is of the members that end there.

    Rollup: a node is exploded to its ancestors within its band only, once for all bands, and hash-aggregated; then, from the deepest band up, the
    completed totals of a band's roots are exploded to the ancestors of their parents in the band above. band_height is the square root of
    the greatest depth by default, 4 at least, so rounds, explosion and windows all stay below about that root. Totals combine before they
    are shuffled; children of one parent are joined, never gathered. Two prefixes with one 128-bit key would fail the query.

    Repeated items of one (conv_id, depth) aren't allowed. Without members the result is empty.
    """
    deepest = items.agg(F.max("depth")).first()[0] or 0
    height = band_height or max(4, math.isqrt(deepest) + 1)
    rows = table(_keyed(items, height), "trie-rows")
    one = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("bytes").alias("bytes"), F.first("path").alias("path"),
        ((F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))).alias("same"),
    )
    checked = F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a key")).cast("long"))
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("bytes"),
        F.array(F.struct(zero.alias("a"), zero.alias("b"))).alias("path"),
    )
    nodes = table(root.unionByName(one.withColumn("n_convs", checked).drop("same")), "trie-nodes")

    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.filter("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    flat = table(
        nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
        .withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-flat",
    )

    def spread(found: DataFrame, path: str, below: Column) -> DataFrame:
        """Totals at every node of a path that leads to depth below."""
        at = found.select(F.posexplode(path).alias("i", "node"), (below - F.size(path) + 1).alias("top"), "leaves", "saved")
        return at.select((F.col("top") + F.col("i")).cast("long").alias("depth"), "node.a", "node.b", "leaves", "saved").groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    totals = table(spread(flat, "path", F.col("depth")), "trie-bands")
    tops = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("path").alias("above"))
    parts = [totals]
    if deepest >= height:
        links = table(nodes.filter((F.col("depth") > 0) & (F.col("depth") % height == 0)).select(*KEY, "pa", "pb").join(tops, ["depth", "pa", "pb"]).select(*KEY, "above"), "trie-links")
        for depth in range(deepest // height * height, 0, -height):
            done = totals.filter(F.col("depth") == depth)
            if len(parts) > 1:
                done = done.unionByName(parts[-1].filter(F.col("depth") == depth)).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            carried = done.join(links.filter(F.col("depth") == depth), KEY)
            parts.append(table(spread(carried, "above", F.col("depth") - 1), "trie-carried"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sums = whole.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = members.select("conv_id").distinct().join(rows.select("conv_id", *KEY).join(last, ["conv_id", "depth"]), "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in KEY))
    return (
        flat.join(parents, ["depth", "pa", "pb"], "left").join(sums, KEY).join(_member_digests(ends), KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "a", "b")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = turn_items(read(spark, sf_dir, "conversations"))
    return prefix_trie(table(rebuilt(items), "rebuilt-turns"), items.select("conv_id").distinct()).drop("a", "b")


_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(c::varchar, ''), lambda s: ord(s)::bigint)), lambda k, x: xor(k >> 8, t[1 + (xor(k, x) & 255)]))"

SQL = {
    "op11_prefix_trie": f"""
        WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
                 SELECT i, list_reduce(list_concat([i], range(8)), lambda k, s: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END) AS v FROM range(256) r(i))),
             turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
                       FROM conversations WHERE conv_id IS NOT NULL),
             sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
             plan AS (SELECT s.c, s.c - s.c % 5 AS base, xor(4294967295, {_CRC}) % 9 AS h FROM sizes s, crc),
             placed AS (SELECT plan.c, least(h, coalesce(b.n, 0)) AS m, base, h FROM plan LEFT JOIN sizes b ON b.c = base),
             built AS (SELECT q.c, p AS d, r, x FROM placed q JOIN turns t ON t.c = q.base AND t.p <= q.h
                       UNION ALL SELECT q.c, m + p - h, r, x FROM placed q JOIN turns t ON t.c = q.c AND t.p > q.h),
             paths AS (SELECT c, d, strlen(x) AS bytes, list(r || chr(1) || x) OVER (PARTITION BY c ORDER BY d) AS path FROM built
                       UNION ALL SELECT c, 0, 0, []::varchar[] FROM sizes),
             nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM paths GROUP BY path, d),
             ends AS (SELECT path, sha256(string_agg(c::varchar, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM paths GROUP BY c) GROUP BY path),
             kids AS (SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY path[:d - 1]),
             known AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
             sums AS (SELECT path[:k] AS path, sum((n_children = 0)::int) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS k FROM known) GROUP BY path[:k])
        SELECT k.conv_id, k.d::bigint AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens,
               coalesce(ends, sha256('')) AS ends_sha256
        FROM known k JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON k.d > 0 AND p.path = k.path[:k.d - 1]""",
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
