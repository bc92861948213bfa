"""Periodic runs of words by suffix-tree LCE: Ukkonen trees of a document and its reversal, Euler-tour LCA, Lyndon roots extended both ways."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, in_calls, read

#: White space between words, as in the contract: space and \t to \r. bytes.split() without an argument splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def ukkonen(symbols: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """The suffix tree of symbols, whose last one must occur nowhere else: start and end of each node's edge, and its children by first symbol (None: leaf)."""
    n = len(symbols)
    start, end, kids, link = [0] * (2 * n), [n] * (2 * n), [None] * (2 * n), [0] * (2 * n)
    kids[0], end[0], nodes = {}, 0, 1
    node = edge = length = pending = 0
    for i, symbol in enumerate(symbols):
        pending, unlinked = pending + 1, 0
        while pending:
            if not length:
                edge = i
            branch = kids[node]
            head = symbols[edge]
            child = branch.get(head)
            if child is None:
                branch[head] = nodes
                start[nodes] = i
                nodes += 1
                if unlinked:
                    link[unlinked], unlinked = node, 0
            else:
                first = start[child]
                span = end[child] - first
                if length >= span:
                    edge, length, node = edge + span, length - span, child
                    continue
                middle = first + length
                if symbols[middle] == symbol:
                    if unlinked:
                        link[unlinked] = node
                    length += 1
                    break
                branch[head] = nodes
                start[nodes], end[nodes], kids[nodes] = first, middle, {symbols[middle]: child, symbol: nodes + 1}
                start[child], start[nodes + 1] = middle, i
                if unlinked:
                    link[unlinked] = nodes
                unlinked = nodes
                nodes += 2
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return start, end, kids


class Lce:
    """Longest common extensions of the suffixes of a sequence, each in constant time.

    The Euler tour of the suffix tree, children by rising symbol, is kept where it turns from one leaf to the next: there it stands
    on the lowest common ancestor of both. The ancestor of any two leaves is the shallowest such node between them, which a
    sparse table of range minima gives.
    """

    def __init__(self, symbols: list[int]):
        """symbols: positive; a last symbol 0 is added here."""
        n = len(symbols) + 1
        start, end, kids = ukkonen([*symbols, 0])
        leaves, turns, turn = [], [], 0
        above, stack = [0] * len(start), [0]
        while stack:
            node = stack.pop()
            if node < 0:  # not the first child: the tour comes from its parent
                node = ~node
                turn = above[node]
            below = kids[node]
            if below is None:
                leaves.append(start[node] - above[node])
                turns.append(turn)
                continue
            depth = above[node] + end[node] - start[node]
            order = [below[s] for s in sorted(below, reverse=True)]
            for child in order:
                above[child] = depth
            first = order.pop()
            stack += [~child for child in order]
            stack.append(first)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.minima = [np.asarray(turns, np.int32)]
        while 2 << (len(self.minima) - 1) <= n:
            row, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j share from their start on; i and j differ, and may be the end of the sequence."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return out


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word from each position ends, by rising and by falling order of symbols: at the next smaller, or next greater, suffix."""
    values = rank.tolist()
    smaller, greater = [0] * len(values), [0] * len(values)
    low, high = [], []
    for i in range(len(values) - 1, -1, -1):
        v = values[i]
        while low and values[low[-1]] > v:
            low.pop()
        while high and values[high[-1]] < v:
            high.pop()
        smaller[i] = low[-1] if low else len(values)
        greater[i] = high[-1] if high else len(values)
        low.append(i), high.append(i)
    return np.asarray(smaller), np.asarray(greater)


def maximal_runs(symbols: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence that is long enough, sorted; min_exponent is at least 2.

    Every run holds a longest Lyndon word, by one of the two orders, as its root. A run of exponent e holds one within its first period,
    whose extension to the right covers e - 2 further periods at least; only such candidates need the tree of the reversal. At the end of
    the sequence the falling order can give a power of a root; it makes the same stretch, of which the least period counts.
    """
    n = len(symbols)
    forward = Lce(symbols)
    found: dict[tuple[int, int], int] = {}
    at, end = [], []
    for ends in lyndon_ends(forward.rank[:n]):
        i = np.arange(n)
        right = forward(i, ends)
        keep = right >= (min_exponent - 2) * (ends - i)
        at.append(i[keep]), end.append(ends[keep])
    i, j = np.concatenate(at), np.concatenate(end)
    if len(i):
        backward = Lce(symbols[::-1])
        right, left = forward(i, j), backward(n - i, n - j)
        start, length, period = i - left, right + left + j - i, j - i
        keep = length >= np.maximum(min_length, min_exponent * period)
        for stretch, p in zip(zip(start[keep].tolist(), length[keep].tolist()), period[keep].tolist()):
            found[stretch] = min(p, found.get(stretch, p))
    return sorted(((s, size, p) for (s, size), p in found.items()), key=lambda r: (r[0], r[2]))


def _stretches(good: np.ndarray, at: np.ndarray, min_length: int) -> np.ndarray:
    """Which of the places `at` lie in a stretch of good triples that is long enough; good[k] tells of the triple from at[k] on, whose places are neighbours."""
    padded = np.concatenate(([False], good, [False]))
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    first, last = edge[::2], edge[1::2] + 2  # words of a stretch, the last one excluded
    long = last - first >= min_length
    step = np.zeros(len(at) + 1, np.int64)
    np.add.at(step, first[long], 1)
    np.add.at(step, last[long], -1)
    return at[np.cumsum(step[:-1]) > 0]


def struck(words: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence without words that can be in no run, with a separator of its own for each gap, and every symbol's place.

    In a run of exponent e every three neighbouring words occur e - 1 times at least (two less than its length, if the period is 1), and
    again at a distance of one e-th of the stretch at most. Words outside stretches of such triples are in no run, and no run leaves its
    stretch. Stretches are filtered again until nothing goes. Triples are told apart by hashes, which can keep too much, never too little.
    Runs that may have fewer than three periods, or three words, are not filtered for.
    """
    if min_exponent < 3 or max(min_length, min_exponent) < 4:
        return words, np.arange(len(words))
    at, mix = np.arange(len(words)), np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    if len(at) >= min_length:
        bits = (4 * len(words)).bit_length()
        w = words.astype(np.uint64)
        slot = ((w[:-2] * mix[0] + w[1:-1] * mix[1] + w[2:] * mix[2]) >> np.uint64(64 - bits)).astype(np.int64)
        at = _stretches(np.bincount(slot, minlength=1)[slot] >= min(min_exponent - 1, max(min_length, min_exponent) - 2), at, min_length)
    while len(at) >= min_length:
        stretch = np.cumsum(np.concatenate(([0], np.diff(at) > 1)))
        size = np.bincount(stretch)[stretch]
        w = words[at].astype(np.uint64)
        code = w[:-2] * mix[0] + w[1:-1] * mix[1] + w[2:] * mix[2] + stretch[:-2].astype(np.uint64) * mix[3]
        order = np.argsort(code, kind="stable")
        gap = np.where(code[order[1:]] == code[order[:-1]], at[order[1:]] - at[order[:-1]], len(words))
        nearest = np.full(len(code), len(words))
        nearest[order[1:]] = gap
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
        kept = _stretches((nearest * min_exponent <= size[:-2]) & (at[2:] - at[:-2] == 2), at, min_length)
        if len(kept) == len(at):
            break
        at = kept
    else:
        return words[:0], at[:0]
    gaps = np.flatnonzero(np.diff(at) > 1)
    return np.insert(words[at], gaps + 1, len(words) + np.arange(len(gaps))), np.insert(at, gaps + 1, 0)


def document_runs(words: list, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, sorted by start, then period."""
    number: dict = {}
    ids = np.fromiter(map(number.setdefault, words, range(len(words))), np.int64, len(words))
    symbols, place = struck(ids, min_length, min_exponent)
    if not len(symbols):
        return []
    return [(int(place[s]), length, period) for s, length, period in maximal_runs((symbols + 1).tolist(), min_length, min_exponent)]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of every run its first period stays, unless another run drops it."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length, period in words, by start and period), strongest (the run with the greatest
    exact length/period; ties: least start, then period; null without a run) and collapsed (the text with each run's repetitions dropped).

    A run is a stretch of words with smallest period q (words q apart are identical), of min_length words and min_exponent periods at least,
    that no neighbouring word extends. min_exponent is 2 at least, min_length 3 at least. Words are what lies between ASCII white space.
    Documents are independent: no shuffle takes place and memory is that of one document's trees (about 1 KB a word of what the exact filter leaves).

    Null and empty texts have no runs and collapse to the empty text; ids may be null or repeated, each row gets its result; an empty table
    gives an empty result; other columns are ignored. Texts of any length are read whole.
    """
    if min_exponent < 2 or min_length < 3:
        raise ValueError("min_exponent must be at least 2, min_length at least 3")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for batch in batches for p in in_calls(batch)):
            rows = []
            for text in part["text"]:
                words = text.encode().split()
                runs = document_runs(words, min_length, min_exponent)
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                named = [dict(zip(("start", "length", "period"), r)) for r in runs]
                rows.append((named, best and dict(zip(("start", "length", "period"), best)), b" ".join(collapsed(words, runs)).decode()))
            yield pd.DataFrame({"doc_id": part["doc_id"], **dict(zip(("runs", "strongest", "collapsed"), map(list, zip(*rows))))})

    one = "struct<start: long, length: long, period: long>"
    return id_text(docs, id_col, text_col).mapInPandas(run, f"doc_id long, runs array<{one}>, strongest {one}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which one in ten repeats its tail: h = crc32(decimal doc_id), g = h div 10; where h % 10 = 0 and the
    text has n > 0 words, word i >= a becomes word a + (i - a) % p with a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id is never chosen."""
    rows = id_text(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    placed = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return period.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.floor(1000 * best.length / best.period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda s: ord(s)::bigint)), lambda k, x: xor(k >> 8, t[1 + (xor(k, x) & 255)]))"

#: Two words p apart open five equal words each time: so pairs of equal five-word stretches, in islands of one distance, are the runs.
SQL = {
    "op12_periodic_runs": f"""
        WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
                 SELECT i, list_reduce(list_concat([i], range(8)), lambda k, s: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END) AS v FROM range(256) r(i))),
             given AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, {_CRC}) END AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc),
             placed AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM given),
             period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
             docs AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM period),
             words AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
             five AS (SELECT r, i, word || chr(1) || lead(word, 1) OVER o || chr(1) || lead(word, 2) OVER o || chr(1) || lead(word, 3) OVER o || chr(1) || lead(word, 4) OVER o AS gram FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
             pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i),
             island AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k),
             run AS (SELECT r, start, length, min(q) AS period FROM island WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
             told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY r),
             best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM run) WHERE k = 1),
             dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
             kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS said FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(told.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
        FROM docs LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
}
QUERIES = {"op12_periodic_runs": op12_periodic_runs}
