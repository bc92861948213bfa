"""Near-duplicate detection by order MinHash (Marçais et al., 2019) and banded alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import discard
from ._common import bucketed, id_text, in_calls, read, table

#: Edit similarity of words from which two texts are near duplicates.
SIMILARITY = 0.8
#: Families of sketches: words of a k-mer, minimum k-mers that make a key, sketches. The first finds common passages of
#: five words; the second, of single words in their order, finds texts whose edits leave few such passages.
FAMILIES = ((5, 2, 24), (1, 4, 16))
#: Words of a text up to which its near duplicates are found for certain, by pieces that an edit cannot all reach.
SHORT = 25
#: Least and most bins (as powers of two) of the word counts that part unlike texts; between them, as many as a text has words or more.
LEAST_BINS, MOST_BINS = 6, 12
#: Numbers hashed at once for one text, texts that a task remembers so as to sketch copies once, and texts in a batch.
HASHED, SEEN, BATCH = 4_000_000, 500_000, 500
#: Orders of the nodes by which buckets pick the members that the others are compared with.
ORDERS = 4
#: Members of a bucket that are compared in one block; of larger buckets each two parts are a block, which a task compares by itself.
PART = 1_000
#: The same for the members that have a partner which sizes and counts allow, whose texts a task then compares.
CLOSE_PART = 250
#: Counts that a task holds at once while it compares a block.
COMPARED = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_SEEDS = _mix(np.arange(1, 1 + sum(f[2] for f in FAMILIES), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = _mix(np.arange(101, 101 + SHORT, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k-mer of word hashes together with the number of its equals before it; a shorter text is one k-mer."""
    n = len(words) - k + 1
    if n < 1:
        return _mix((words * _PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    kmers = words[:n] * _PLACES[0]
    for j in range(1, k):
        kmers = kmers + words[j : j + n] * _PLACES[j]
    kmers = _mix(kmers)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if again.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(again, 0, at))
        kmers[order] = np.where(again, _mix(ranked + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ranked)
    return kmers


def sketch_keys(words: np.ndarray) -> np.ndarray:
    """A key for each sketch: it orders the labelled k-mers by a hash of its own, takes the first few and hashes them in text order."""
    keys, used = [], 0
    for k, depth, sketches in FAMILIES:
        kmers, seeds = labelled_kmers(words, k), _SEEDS[used : used + sketches]
        used += sketches
        most, step = min(depth, len(kmers)), max(1, HASHED // len(kmers))
        for i in range(0, sketches, step):
            own = seeds[i : i + step]
            hashed, rows, least = _mix(kmers[None, :] ^ own[:, None]), np.arange(len(own)), []
            for _ in range(most):
                least.append(hashed.argmin(1))
                hashed[rows, least[-1]] = np.uint64(2**64 - 1)
            in_order = kmers[np.sort(np.stack(least, 1), axis=1)]
            keys.append(_mix((in_order * _PLACES[:most]).sum(1) + own))
    return np.concatenate(keys).astype(np.int64)


def piece_keys(words: np.ndarray) -> np.ndarray:
    """Keys of a short text: any two texts of the similarity and SHORT words at most share one.

    A text of n words that may differ by e edits is cut into e + 1 pieces. In any near duplicate a piece i is left whole
    that has i edits before it and e - i after it at most, and moved by no more (Li et al., 2011). The key names n, the
    piece and its words; a text has keys as the longer and as the shorter of a pair.
    """
    keys, size = [], len(words)
    for longer in range(size, SHORT + 1):
        most, less = int((1 - SIMILARITY) * longer + 1e-9), size - longer
        if -less > most:
            break
        cuts = [longer * i // (most + 1) for i in range(most + 2)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            for start in range(max(0, a + max(-i, less - (most - i))), min(size - (b - a), a + min(i, less + most - i)) + 1):
                keys.append((words[start : start + b - a] * _PLACES[: b - a]).sum() + np.uint64(longer * 64 + i) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(np.array(keys, np.uint64)).astype(np.int64)


def text_keys(words: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([sketch_keys(words), piece_keys(words)]) if len(words) <= SHORT else sketch_keys(words))


def word_counts(words: np.ndarray) -> np.ndarray:
    """Words by bin of their hash, up to 255 in each; an edit changes two bins by one at most."""
    bins = 1 << min(MOST_BINS, max(LEAST_BINS, len(words).bit_length()))
    return np.minimum(np.bincount((words % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def counts_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the edits between two texts, from their word counts; the finer counts are added up to the bins of the others.

    A sum with a full bin is full too, as its true value is; so both sides are true counts cut off at 255, and those differ by no more than the counts.
    """
    x, y = (np.frombuffer(c, np.uint8).astype(np.int32) for c in sorted((a, b), key=len))
    gap = x - np.minimum(y.reshape(-1, len(x)).sum(0), 255)
    return int(max(gap[gap > 0].sum(), -gap[gap < 0].sum()))


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("hash", pa.binary()), ("size", pa.int64()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64())), ("text", pa.string())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of a task's texts. A text without words, or met before in the task, has no keys."""
    seen: set[bytes] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            lists = batch.column("words")
            flat, cuts, hashes = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets), batch.column("hash").to_pylist()
            for start in range(0, batch.num_rows, BATCH):
                part = range(start, min(start + BATCH, batch.num_rows))
                sizes, counts, keys, news = [], [], [], []
                for i in part:
                    words = flat[cuts[i] : cuts[i + 1]]
                    new = len(words) > 0 and hashes[i] not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(hashes[i])
                    sizes.append(len(words))
                    counts.append(word_counts(words).tobytes() if new else None)
                    keys.append(text_keys(words) if new else None)
                    news.append(new)
                given = batch.slice(start, len(part))
                text = given.column("text").take(pa.array([j if new else None for j, new in enumerate(news)], pa.int64()))
                yield pa.RecordBatch.from_arrays([given.column("doc_id"), given.column("hash"), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64())), text], schema=_SKETCHED)


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else a larger number.

    Only the band of the table within `most` of the diagonal is computed, as bit vectors of its differences that move
    down the diagonal (Hyyrö, 2003).
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    lo = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if not m or not most:
        return n
    d = min(most, m - 1)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    if n - m > d or d < most:  # the band covers the whole table
        vp, vn, full, last, score = (1 << m) - 1, 0, (1 << m) - 1, 1 << m - 1, m
        for x in b:
            eq = at.get(x, 0) | vn
            d0 = ((vp + (eq & vp)) ^ vp) | eq
            hp, hn = (vn | ~(vp | d0)) & full, vp & d0
            score += bool(hp & last) - bool(hn & last)
            hp = hp << 1 | 1
            vn, vp = hp & d0 & full, (hn << 1 | ~(hp | d0)) & full
        return score
    width = 2 * d + 1
    full = (1 << width) - 1
    vp, vn, score = full & ~((1 << d) - 1), 0, d
    low, row, give_up = 1 << width - 1, 1 << width - 2, d + n - (m - d)
    for j, x in enumerate(b):
        eq = at.get(x, 0)
        eq = (eq >> (j - d) if j >= d else eq << (d - j)) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j < m - d:
            score += not d0 & low
            if score > give_up:
                return most + 1
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, (d0 >> 1) & hp
    return score


def similar(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / length of the longer reaches the similarity, by words. Texts without words are not similar."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if not a or not b or abs(len(a) - len(b)) > most:
        return False
    left = Counter(a)
    left.subtract(b)
    if max(sum(x for x in left.values() if x > 0), -sum(x for x in left.values() if x < 0)) > most:
        return False
    return edit_distance(a, b, most) <= most


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = [similar(x.split(), y.split()) for x, y in zip(batch["text"], batch["other_text"])]
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "same": same})


def _may_be_similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that sizes and word counts do not rule out."""
    for batch in batches:
        for part in in_calls(batch, 10_000):
            most = ((1 - SIMILARITY) * np.maximum(part["size"], part["other_size"]).to_numpy() + 1e-9).astype(np.int64)
            near = (part["size"] - part["other_size"]).abs().to_numpy() <= most
            fits = [ok and counts_apart(a, b) <= m for ok, a, b, m in zip(near, part["counts"], part["other_counts"], most)]
            yield part.loc[fits, ["a", "b"]]


def alike_in_block(component: np.ndarray, part: np.ndarray, size: np.ndarray, counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block across components (and across parts, if it has two) that sizes and word counts do not rule out, as counts_apart has it.

    Members are taken by size, each with those up to 1 / SIMILARITY as long, whose bins are as many or twice as many.
    """
    order, two, none = np.argsort(size, kind="stable"), part.min() != part.max(), np.zeros(0, np.int64)
    component, part, size, counts = component[order], part[order], size[order], [counts[i] for i in order]
    if (component == component[0]).all():
        return none, none
    most = ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)
    bins, end = np.array([len(c) for c in counts]), np.searchsorted(size - most, size, "right")  # of the longer one the edits are counted
    left, right = [none], [none]
    for n in np.unique(bins):
        own = np.flatnonzero(bins == n)
        first, last = own[0], end[own].max()  # bins grow with sizes, so the members of one number of bins are in a row
        folded = np.empty((last - first, n), np.int16)
        for i, c in enumerate(counts[first:last]):
            folded[i] = np.minimum(np.frombuffer(c, np.uint8).reshape(-1, n).sum(0, dtype=np.int32), 255)
        total, start = folded.sum(1, dtype=np.int32), 0
        while start < len(own):
            stop = min(len(own), start + max(1, int((COMPARED / n) ** 0.5)))
            while stop > start + 1 and (stop - start) * (end[own[stop - 1]] - own[start]) * n > COMPARED:
                stop = (start + stop) // 2
            rows, low, high = slice(start, stop), start, end[own[stop - 1]] - first
            apart = np.abs(folded[rows, None] - folded[None, low:high]).sum(2, dtype=np.int32)
            a, b = own[rows][:, None], np.arange(low, high)[None] + first
            bound = (apart + np.abs(total[own[rows] - first][:, None] - total[None, low:high])) // 2
            fits = (bound <= most[b]) & (b > a) & (b < end[a]) & (component[a] != component[b])
            if two:
                fits &= part[a] != part[b]
            i, j = np.nonzero(fits)
            left.append(order[a[i, 0]])
            right.append(order[b[0, j]])
            start = stop
    return np.concatenate(left), np.concatenate(right)


def _by_block(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work of each block of rows sorted by bucket and block, if its members are of several components; one block is unpacked at a time, besides a batch."""

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        x = rows["x"].to_numpy()
        if (x != x[0]).any():
            yield work(rows)

    held, last = [], None
    for batch in batches:
        key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and (key[start], block[start]) != last:
                yield from done(held)
                held = []
            held, last = [*held, batch.slice(start, stop - start)], (key[start], block[start])
    if held:
        yield from done(held)


def _alike(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return alike_in_block(*(rows[c].to_numpy() for c in ("x", "part", "size")), rows["counts"].to_pylist())


_CLOSE = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _close_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that are in a pair of alike_in_block: a row for each member at most, however many pairs there are."""

    def close(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()[np.unique(np.concatenate(_alike(rows)))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), rows["key"][0].as_py(), np.int64)), pa.array(node)], schema=_CLOSE)

    return _by_block(batches, close)


def met_before(keys: list[list[int]], key: int) -> np.ndarray:
    """For each two members of a block whether they share a key less than this one, in whose block they are compared."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.array([k for own in keys for k in own], np.int64)
    found, code, n = np.unique(flat[flat < key], return_inverse=True, return_counts=True)
    owner, met = owner[flat < key], np.zeros((len(keys), len(keys)), bool)
    several = np.flatnonzero(n > 1)
    for start in range(0, len(several), PART):
        place = np.full(len(found), -1)
        place[several[start : start + PART]] = np.arange(len(several[start : start + PART]))
        own = place[code] >= 0
        has = np.zeros((len(keys), min(PART, len(several) - start)), np.float32)
        has[owner[own], place[code[own]]] = 1
        met |= has @ has.T > 0
    return met


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between similar members of each block, as many as connect what is not connected yet: fewer than its members, however many pairs are similar."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        left, right = _alike(rows)
        if len(left):
            new = ~met_before(rows["keys"].to_pylist(), rows["key"][0].as_py())[left, right]
            left, right = left[new], right[new]
        node, text, words, joined = rows["node"].to_numpy(), rows["text"], {}, {}
        component = pd.factorize(rows["x"].to_numpy())[0].tolist()

        def root(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = joined.get(up, up)
                c = up
            return c

        def split(i: int) -> list[str]:
            if i not in words:
                words[i] = text[i].as_py().split()
            return words[i]

        found = []
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = root(component[i]), root(component[j])
            if a != b and similar(split(i), split(j)):
                joined[max(a, b)] = min(a, b)
                found.append((i, j))
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], schema=_LINKS)

    return _by_block(batches, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_md5 (of the lower-case text), class_id (least doc_id of its class), kept.

    Texts are compared as lower-case words; a link needs an edit similarity of 0.8 or more, found by banded alignment.
    Equal texts are one node. A node has 40 order-MinHash keys (FAMILIES), and up to SHORT words the keys of its pieces;
    nodes that share a key form a bucket. Each bucket pairs its members with two of them, the first and the last in one of
    a few orders, so that pairs grow in proportion to the members, and buckets of three or fewer are compared in full.
    First every node is compared with the partner it shares most keys with; then one pair for any two components that
    pairs still connect; then all pairs whose ends are not connected yet; last, in buckets that still have several components, all
    pairs across components, so that no bucket leaves out a link. Texts of nodes with a pair are kept in a table
    that is bucketed by node, so that they are shuffled once. Sizes and word counts rule out most unlike pairs before their texts are read.
    Classes are the connected components of the links. No bucket is capped, no task gathers one, and nothing that
    grows with the data is broadcast or collected.

    Pairs of SHORT words at most are candidates for certain, longer ones by chance per sketch. Two similar texts that share a
    key are in one class, however many share it. That last step is quadratic in unlike texts of one size that share a passage, but only in comparisons
    within a task, of word counts and then of texts that those allow: it is dealt over tasks and bounded in memory, and no pair becomes a row. Copies take no part in it.

    Of a class one row stays (kept): the one of the least (doc_id, text_md5), with its exact repetitions. Texts without
    words (null, empty, white space) are classes by equality. Rows of one id and different texts are judged each by its
    text. A row with a null id is kept and has a null class_id. An empty table gives an empty result; other columns are
    ignored.
    """
    given = id_text(docs, id_col, text_col).withColumn("text", F.lower("text"))
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    schema = "doc_id long, hash binary, size long, counts binary, keys array<long>, text string"
    hashed = given.select("doc_id", F.unhex(F.md5("text")).alias("hash"), words.alias("words"), "text")
    sketches = table(hashed.mapInArrow(_sketch, schema).withColumn("node", F.monotonically_increasing_id()), "sketches")
    nodes = table(sketches.groupBy("hash").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("keys").isNotNull(), F.col("node"))).alias("node"), F.count("keys").alias("n")), "nodes")
    sketched = sketches.filter("keys is not null")
    again = sketched.select("hash", "node").join(nodes.filter("n > 1").select("hash", F.col("node").alias("first")), "hash").filter("node <> first").select("node")
    entries = sketched.select("node", "keys").join(again, "node", "left_anti").select("node", F.explode("keys").alias("key"))
    turned = lambda x: x.bitwiseXOR(F.pmod("key", F.lit(ORDERS)) * 0x1234567890ABCD)  # noqa: E731  one of a few orders of the nodes
    picked = [f(turned(F.col("node"))).alias(c) for f, c in ((F.min, "p"), (F.max, "q"))]
    buckets = entries.groupBy("key").agg(*picked, F.count(F.lit(1)).alias("n")).filter("p <> q").select("key", turned(F.col("p")).alias("p"), turned(F.col("q")).alias("q"), "n")
    shared = table(entries.join(buckets, "key"), "shared-keys")
    met = shared.select("node", F.explode(F.array("p", "q")).alias("with")).filter("node <> with")
    sized = lambda end, name: sketched.select(F.col("node").alias(end), F.col("size").alias(name))
    met = met.groupBy(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).agg(F.count(F.lit(1)).alias("shared")).join(sized("a", "size"), "a").join(sized("b", "other_size"), "b")
    near = F.abs(F.col("size") - F.col("other_size")) <= F.floor(F.greatest("size", "other_size") * (1 - SIMILARITY) + 1e-9)
    pairs = table(met.filter(near).select("a", "b", "shared"), "candidate-pairs")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("with")), F.struct(F.col("b").alias("node"), F.col("a").alias("with"))))
    best = table(pairs.select(ends.alias("e"), "shared").groupBy("e.node").agg(F.max_by("e.with", "shared").alias("with")), "best-partners")
    texts = bucketed(sketched.select("node", "size", "counts", "text"), "node", "candidate-texts", best.select("node").unionByName(shared.filter("n > 3").select("node")).distinct())
    rows = table(sketches.select("doc_id", "hash"), "rows")
    discard(sketches)

    def side(end: str, pre: str, *columns: str) -> DataFrame:
        return texts.select(F.col("node").alias(end), *(F.col(c).alias(f"{pre}{c}") for c in columns))

    def verified(alike: DataFrame) -> DataFrame:
        whole = alike.join(side("a", "", "text"), "a").join(side("b", "other_", "text"), "b")
        return table(whole.mapInPandas(_verify, "a long, b long, same boolean").filter("same").select("a", "b"), "links")

    def linked(found: DataFrame) -> DataFrame:
        counted = found.join(side("a", "", "size", "counts"), "a").join(side("b", "other_", "size", "counts"), "b")
        return verified(table(counted.mapInPandas(_may_be_similar, "a long, b long"), "alike-pairs"))

    def apart(links: DataFrame) -> DataFrame:
        """The pairs whose ends no link connects yet, with their components."""
        parts = table(connected_components(links), "components")
        place = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
        placed = pairs.join(place("a", "x"), "a", "left").join(place("b", "y"), "b", "left").withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})
        return placed.filter("x <> y")

    def in_blocks(members: DataFrame, part: int, *columns: str) -> DataFrame:
        """Members (node, x, key, n: of the key) with the text's columns, dealt by key and block: of keys of more than `part` members each two parts are a block."""
        held = members.groupBy("node").agg(F.first("x").alias("x"), F.collect_list(F.struct("key", (1 + F.expr(f"n div {part}")).alias("deals"))).alias("held"))
        whole = held.join(texts.select("node", "size", "counts", *columns), "node").withColumn("keys", F.col("held.key"))
        dealt = whole.select("*", F.explode("held").alias("h")).select("*", "h.*").withColumn("part", F.pmod(F.xxhash64("node"), "deals"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).withColumn("block", F.least("part", "other") * F.col("deals") + F.greatest("part", "other"))
        return dealt.select("key", "block", "part", "node", "x", "size", "counts", *(["keys"] if columns else []), *columns).repartition("key", "block").sortWithinPartitions("key", "block")

    def unmet(links: DataFrame) -> DataFrame:
        """Links for the pairs of a bucket that no link connects yet, picked members among them.

        Buckets of one component have none. Buckets of the same members, as a shared passage makes them, are compared once. A task compares the
        sizes and word counts of the members of a block by itself and passes on those that have a partner; then, of these, the texts, each pair in
        the block of the least key that it shares. Pairs never become rows: only members do, and links that connect components.
        """
        parts = table(connected_components(links), "components")
        placed = table(shared.filter("n > 3").select("key", "node", "n").join(parts, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("x")), "crowded-keys")
        same = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
        mixed = placed.groupBy("key").agg(F.max("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *same).filter("low <> high")
        once = mixed.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
        members = placed.join(once, "key", "left_semi")
        close = table(in_blocks(members, PART).mapInArrow(_close_in_blocks, "key long, node long").distinct(), "close-members")
        sized = close.join(close.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").join(parts, "node", "left").select("node", "key", "n", F.coalesce("component", "node").alias("x"))
        return table(in_blocks(sized, CLOSE_PART, "text").mapInArrow(_links_in_blocks, "a long, b long"), "links")

    links = linked(best.select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct())
    bridge = F.max_by(F.struct("a", "b"), "shared").alias("e")
    links = links.unionByName(linked(apart(links).groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(bridge).select("e.*")))
    links = links.unionByName(linked(apart(links).select("a", "b")))
    links = links.unionByName(unmet(links))
    classes = table(connected_components(links), "classes")
    least = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "hash"))
    members = classes.join(nodes, "node").select("component", "least", "hash")
    named = classes.join(members.groupBy("component").agg(least.alias("keep")), "component").select("node", "keep")
    by_text = nodes.join(named, "node", "left").select("hash", F.coalesce("keep.least", "least").alias("class_id"), F.coalesce("keep.hash", "hash").alias("keep_hash"))
    return rows.join(by_text, "hash").select(
        "doc_id", F.lower(F.hex("hash")).alias("text_md5"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        (F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("hash") == F.col("keep_hash")))).alias("kept"),
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op1_near_dedup": op1_near_dedup}
