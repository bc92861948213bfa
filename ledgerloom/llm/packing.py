"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, table

#: Permitted sequence lengths in tokens, and what a sequence costs besides its tokens.
CAPACITIES, OPENING = (512, 1024, 2048, 4096), 16
#: Rows that are packed together, about.
BLOCK = 20_000


def _cheapest_fill(sizes: list[int], left: list[int], caps: Sequence[int], opening: int) -> tuple[int, list[int]]:
    """The bin that costs least for each token it gets, with its contents: the largest item left, then again and again the best fit.

    sizes: ascending sizes that are left, left: how many of each. Every permitted length that holds the largest item is
    filled on trial from what still follows, and counts at the length it can be downsized to. Ties go to the shorter one.
    """
    best = None
    for cap in caps[bisect_left(caps, sizes[-1]) :]:
        room, taken, used = cap, [], {}
        at = len(sizes) - 1
        while at >= 0:
            size = sizes[at]
            n = min(left[at], room // size)
            if n:
                taken += [size] * n
                used[at] = n
                room -= size * n
            at = min(at, bisect_right(sizes, room)) - 1
        full = cap - room
        cost = (caps[bisect_left(caps, full)] + opening) / full
        if best is None or cost < best[0]:
            best = cost, cap, taken
        if room and sum(used.values()) == sum(left):
            break  # nothing is left for a longer one
    return best[1:]


def _pack_by_cost(sizes: np.ndarray, caps: Sequence[int], opening: int) -> list[list[int]]:
    """Contents of bins, by size: bins are opened one by one at the least cost per token, over all permitted lengths jointly."""
    distinct, counts = np.unique(sizes, return_counts=True)
    distinct, counts, bins = distinct.tolist(), counts.tolist(), []
    while distinct:
        _, taken = _cheapest_fill(distinct, counts, caps, opening)
        repeat = min(counts[bisect_left(distinct, s)] // n for s, n in Counter(taken).items())  # the same bin as often as its contents last
        bins += [taken] * repeat
        for s, n in Counter(taken).items():
            at = bisect_left(distinct, s)
            counts[at] -= n * repeat
            if not counts[at]:
                del distinct[at], counts[at]
    return bins


def _pack_decreasing(sizes: np.ndarray, caps: Sequence[int], least: int) -> list[list[int]]:
    """Contents of bins, by size: best-fit decreasing into open bins; a new one has the permitted length `least`, or the next that holds the item."""
    rooms: list[int] = []  # rooms that occur, ascending
    by_room: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room, own = max(least, caps[bisect_left(caps, s)]), []
            bins.append(own)
        own.append(s)
        if room := room - s:
            if room not in by_room:
                rooms.insert(bisect_left(rooms, room), room)
                by_room[room] = []
            by_room[room].append(own)
    return bins


def pack_block(sizes: np.ndarray, capacities: Sequence[int], opening: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs items of one block: for each item its bin and its start in the bin, and for each bin its capacity.

    Bins are opened at the least cost per token, tried over all permitted lengths with what still follows
    (_pack_by_cost); best-fit decreasing from each permitted length on is tried beside it. Each packing is downsized, every
    bin to the smallest permitted length that holds its contents, and the one of least total cost (capacities plus
    `opening` per bin) stays; ties go to the first. Items must not be larger than the largest capacity.
    """
    caps = sorted(capacities)
    packings = [_pack_by_cost(sizes, caps, opening), *(_pack_decreasing(sizes, caps, least) for least in caps)]
    bins = min(packings, key=lambda found: sum(caps[bisect_left(caps, sum(b))] + opening for b in found))
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(-np.arange(len(sizes)), kind="stable").tolist():
        waiting.setdefault(int(sizes[i]), []).append(i)
    place, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, own in enumerate(bins):
        used = 0
        for s in own:
            i = waiting[s].pop()
            place[i], start[i] = b, used
            used += s
    return place, start, np.array([caps[bisect_left(caps, sum(b))] for b in bins], np.int64)


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, opening: int = OPENING, id_col: str = "doc_id", text_col: str = "text", length=None) -> DataFrame:
    """One row per piece of a document: doc_id, piece, piece_start, tokens, block, bin, capacity, bin_start.

    A document's length is its number of white-space separated tokens, or the column `length` (such as n_tokens of a
    tokenizer). Documents longer than the largest capacity are cut into pieces of that capacity and a rest, so nothing is
    dropped or truncated. Pieces are dealt into blocks of about 20,000 by a hash of their row's number and their own,
    and each block is packed by pack_block in one task. Blocks are counted in pieces, and no column of the data decides a
    block, so no source, id, text or length can crowd one. Row numbers are fixed in a table of lengths first. Only
    lengths are shuffled. (block, bin) names a sequence; bin_start is the piece's offset in it.

    Null and empty texts, and null or negative lengths, give one piece of 0 tokens with null bin, capacity and bin_start.
    Null and repeated ids and repeated rows are packed as often as they occur. An empty table gives an empty result.
    Other columns are ignored.
    """
    caps = sorted(capacities)
    largest = caps[-1]
    if length is None:
        words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
        n = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")
    else:
        n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = table(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("long")
    pieces = rows.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "row", "piece", (F.col("piece") * largest).alias("piece_start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest).cast("long")).alias("tokens")
    )
    blocks = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("long"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
        filled = block["tokens"].to_numpy() > 0
        for c in ("bin", "capacity", "bin_start"):
            block[c] = pd.array([pd.NA] * len(block), "Int64")
        if filled.any():
            bins, starts, fitted = pack_block(block.loc[filled, "tokens"].to_numpy(), caps, opening)
            block.loc[filled, "bin"], block.loc[filled, "capacity"], block.loc[filled, "bin_start"] = bins, fitted[bins], starts
        return block.drop(columns="row")

    schema = "doc_id long, piece long, piece_start long, tokens long, block long, bin long, capacity long, bin_start long"
    return dealt.groupBy("block").applyInPandas(pack, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
