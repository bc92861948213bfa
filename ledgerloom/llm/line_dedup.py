"""Line deduplication by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_calls, read, table

#: Blocks into which a line is cut to find the one that an edit can lie in.
BLOCKS = 16
#: Candidate lines up to which their list is broadcast (about 100 bytes each); beyond, it is shuffled.
BROADCAST_LINES = 100_000
#: Keys that a task holds before it hands them on.
HELD_KEYS = 200_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that is not blank: doc_id, version (a hash of the text, so that one id may have several texts), line_no, line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .withColumn("line", _trimmed(F.col("line")))
        .filter(F.col("line") != "")
    )


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share one: the halves of the line seen as the shorter and as the longer of a pair."""
    keys = []
    for base in (n, n - 1):
        half = F.floor(base / 2).cast("int")
        keys += [F.xxhash64(F.substring(line, F.lit(1), half), base, F.lit(0)), F.xxhash64(F.substring(line, n - (base - half) + 1, base - half), base, F.lit(1))]
    return F.array(*keys)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashed:
    """Prefix hashes of a line, from which the hash of the line without a stretch follows in constant time."""

    def __init__(self, line: str):
        self.codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
        self.n = n = len(self.codes)
        powers = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, _BASE, np.uint64), out=powers[1:])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_mix(self.codes + np.uint64(1)) * powers[:n])])

    def without(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the line without [start, stop)."""
        back = np.array([pow(_INVERSE, int(k), 1 << 64) for k in np.unique(stop - start)], np.uint64)[np.unique(stop - start, return_inverse=True)[1]]
        return self.sums[start] + (self.sums[self.n] - self.sums[stop]) * back


def _cuts(base: int) -> np.ndarray:
    return np.arange(BLOCKS + 1) * base // BLOCKS


def _block_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The line without one block, for every block, as the shorter (base = n) and the longer (base = n - 1) of a pair."""
    bases = np.concatenate([np.arange(BLOCKS, dtype=np.int32) * 2, np.arange(BLOCKS, dtype=np.int32) * 2 + 1])
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in in_calls(batch, HELD_KEYS // len(bases)):
                keys = []
                for line in part["line"]:
                    h = _Hashed(line)
                    for longer in (0, 1):
                        cuts = _cuts(h.n - longer)
                        keys.append(_mix(h.without(cuts[:-1], cuts[1:] + longer) * np.uint64(31) + np.uint64(h.n - longer)) + np.arange(BLOCKS, dtype=np.uint64))
                yield pd.DataFrame({"block_key": np.concatenate(keys).view(np.int64), "key": np.repeat(part["key"].to_numpy(), len(bases)), "block": np.tile(bases, len(part))})


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The deletion variants of a line inside the given blocks.

    kind 0: one character deleted, the key also holding its place: lines of equal length that share it differ there only.
    kind 1: one character deleted; kind 2: the line itself. A line equal to another's variant is one deletion away.
    """
    held: list[tuple[np.ndarray, bytes, np.ndarray]] = []
    count = 0
    with np.errstate(over="ignore"):
        for batch in batches:
            for key, line, blocks in zip(batch["key"], batch["line"], batch["blocks"]):
                h = _Hashed(line)
                places = {0: [np.zeros(0, np.int64)], 1: [np.zeros(0, np.int64)]}
                for block, longer in ((int(b) // 2, int(b) % 2) for b in blocks):
                    cuts = _cuts(h.n - longer)
                    places[longer].append(np.arange(cuts[block], cuts[block + 1] + longer))
                once, at = np.unique(np.concatenate(places[0])), np.unique(np.concatenate(places[1]))
                placed = _mix(h.without(once, once + 1)) ^ _mix(once.astype(np.uint64) + (np.uint64(h.n) << np.uint64(32)))
                deleted = np.unique(h.without(at, at + 1))
                kinds = np.repeat(np.arange(3, dtype=np.int32), [len(placed), len(deleted), 1])
                held.append((np.concatenate([placed, deleted, h.sums[-1:]]).view(np.int64), key, kinds))
                count += len(kinds)
                if count >= HELD_KEYS:
                    yield _variant_rows(held)
                    held, count = [], 0
        if held:
            yield _variant_rows(held)


def _variant_rows(held: list[tuple[np.ndarray, bytes, np.ndarray]]) -> pd.DataFrame:
    ids = np.empty(len(held), object)
    ids[:] = [key for _, key, _ in held]
    return pd.DataFrame({"variant": np.concatenate([k for k, _, _ in held]), "key": np.repeat(ids, [len(k) for k, _, _ in held]), "kind": np.concatenate([x for _, _, x in held])})


def _near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First places of the distinct lines that lie within one edit of an earlier line."""
    halves = distinct.select("key", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().filter("count > 1").select("half")
    candidates = halves.join(shared, "half", "left_semi").select("key", "first").distinct()
    wanted = table(
        candidates.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")).agg(F.collect_list(F.struct("first.line_no", "key", "first")).alias("wanted")),
        "line-candidates",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    side = F.broadcast(wanted) if few else wanted
    found = source.join(side, (F.col("hash") == F.col("version")) & F.col("id").eqNullSafe(F.col("doc_id")))
    lines = table(
        found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
        .select("w.key", "w.first", _trimmed(F.col("lines")[F.col("w.line_no")]).alias("line")).dropDuplicates(["key"]),
        "line-texts",
    )
    blocks = lines.select("key", "line").mapInPandas(_block_keys, "block_key long, key binary, block int")
    common = blocks.groupBy("block_key").count().filter("count > 1").select("block_key")
    places = blocks.join(common, "block_key", "left_semi").groupBy("key").agg(F.collect_set("block").alias("blocks"))
    variants = table(
        lines.select("key", "line").join(places, "key").mapInPandas(_variants, "variant long, key binary, kind int").join(lines.select("key", "first"), "key"),
        "line-variants",
    )
    place = F.struct("first", "key")
    one_place, deleted, whole = (F.min(F.when(F.col("kind") == k, place)) for k in (0, 1, 2))
    groups = (
        variants.withColumn("placed", F.col("kind") == 0).groupBy("variant", "placed")
        .agg(F.count(F.lit(1)).alias("n"), one_place.alias("one_place"), deleted.alias("deleted"), whole.alias("whole")).filter("n > 1")
    )
    partner = F.when(F.col("kind") == 0, F.col("one_place")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("deleted"))
    links = (
        variants.withColumn("placed", F.col("kind") == 0).join(groups, ["variant", "placed"])
        .select("key", "first", partner.alias("partner")).filter(F.col("partner.first") < F.col("first"))
        .select("key", "first", F.col("partner.key").alias("other")).distinct()
    )
    left, right = lines.select("key", F.col("line").alias("a")), lines.select(F.col("key").alias("other"), F.col("line").alias("b"))
    return links.join(left, "key").join(right, "other").filter(F.levenshtein("a", "b", 1) >= 0).select("first.*").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated lines taken out, and two more columns: __lines (not blank) and __removed.

    A line is a stretch between line feeds, trimmed of spaces, tabs and carriage returns. It goes if an earlier line,
    by (doc_id, text hash, line number) over the whole table, is equal to it or at most one character edit away, whether
    or not that one stays. This holds for lines of every length, so of lines of a single character only the first stays.
    Blank lines stay. Other lines keep their bytes and order.

    Equal lines are grouped by MD5. For the others, every line emits its deletion variants as hashed keys, equal
    variants are joined, edit distances verified. Before that, lines that cannot have a partner are set aside exactly: two
    lines within one edit share a half, and share all but one of sixteen blocks, so variants are emitted only for
    lines and blocks that share those keys. Each variant group links its members to its earliest one, never all pairs; a
    variant of equal length holds the deleted place, so its whole group lies within one edit of the earliest, and this
    loses no line. Line keys, not texts, are shuffled; texts are joined once with the numbers of the lines to remove.

    Null texts stay null and have no lines; null ids sort first; repeated rows (same id and text) are one document and
    all keep its lines; an empty table gives an empty result; other columns pass through, whatever their names.
    """
    lines = _lines(docs, id_col, text_col).withColumn("key", F.unhex(F.md5("line")))
    n = F.length("line")
    distinct = table(
        lines.withColumn("n", n).withColumn("halves", _half_keys(F.col("line"), F.col("n")))
        .groupBy("key").agg(F.min(F.struct("doc_id", "version", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("halves").alias("halves")),
        "lines",
    )
    place = F.struct("doc_id", "version", "line_no")
    again = lines.select("doc_id", "version", "line_no", "key").join(distinct.filter("copies > 1").select("key", "first"), "key").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "line_no")
    gone = (
        again.unionByName(_near_lines(docs, distinct, id_col, text_col)).groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone"))
        .withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def cut(text, numbers):
            drop = set(numbers.tolist())
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

        return pd.Series([None if g is None else cut(t, g) for t, g in zip(texts, gone)], dtype=object)

    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("__v", F.xxhash64(text))
    joined = whole.join(gone, (F.col("__v") == F.col("__version")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("__id")), "left")
    cut = F.when(F.col("gone").isNotNull(), without(F.when(F.col("gone").isNotNull(), text), F.col("gone"))).otherwise(F.col(f"row.{text_col}"))
    full = F.size(F.filter(F.split(text, "\n"), lambda x: _trimmed(x) != ""))
    return joined.select(F.col("row").withField(text_col, cut).alias("row"), full.cast("long").alias("__lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("__removed")).select(
        "row.*", "__lines", F.greatest(F.col("__removed"), F.lit(0).cast("long")).alias("__removed")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").alias("lines"), F.col("__removed").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = {
    "op3_line_dedup": r"""
        WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
        lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw),
        firsts AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS first, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
        halves AS (
            SELECT line, first, n, n AS base, 0 AS side, left(line, n // 2) AS half FROM firsts
            UNION ALL SELECT line, first, n, n, 1, right(line, n - n // 2) FROM firsts
            UNION ALL SELECT line, first, n, n - 1, 0, left(line, (n - 1) // 2) FROM firsts
            UNION ALL SELECT line, first, n, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM firsts),
        pairs AS (
            SELECT DISTINCT a.first AS first, CASE WHEN a.n >= b.n THEN a.line ELSE b.line END AS long, CASE WHEN a.n >= b.n THEN b.line ELSE a.line END AS short
            FROM halves a JOIN halves b USING (base, side, half) WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
        placed AS (SELECT *, coalesce(list_position(list_transform(range(1, length(short) + 1), lambda i: substring(long, i, 1) <> substring(short, i, 1)), true), length(short) + 1) AS p FROM pairs),
        near AS (
            SELECT DISTINCT first FROM placed
            WHERE (length(long) = length(short) AND substring(long, p + 1) = substring(short, p + 1)) OR (length(long) > length(short) AND substring(long, p + 1) = substring(short, p))),
        marked AS (
            SELECT l.doc_id, l.line_no, l.raw, l.line, l.line <> '' AND (f.first <> {'d': l.doc_id, 'l': l.line_no} OR f.first IN (SELECT first FROM near)) AS gone
            FROM lines l LEFT JOIN firsts f USING (line))
        SELECT doc_id, count(*) FILTER (WHERE line <> '') AS lines, count(*) FILTER (WHERE gone) AS removed,
               sha256(coalesce(string_agg(CASE WHEN NOT coalesce(gone, false) THEN raw END, chr(10) ORDER BY line_no), '')) AS text_sha256
        FROM marked GROUP BY doc_id""",
}
QUERIES = {"op3_line_dedup": op3_line_dedup}
