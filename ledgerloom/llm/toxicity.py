"""Toxicity by two class-conditional Kneser-Ney language models."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ROWS_PER_CALL, id_text, in_calls, read, table

#: Labelled documents that the models are fitted on, at most, for each class. A document counts once.
TOXIC_DOCS, ORDINARY_DOCS = 3_000, 9_000
#: Discounts to choose from: standard deviations by which a class's count must pass what chance gives it, before any of it is kept. From 1 on, a count of 1 never is.
SPREADS = (1.0, 2.0, 3.0, 4.0, 6.0)
#: Weight that keeps the slope finite where the ratio parts the classes.
RIDGE = 1e-3
#: Characters of text for each bucket in which distinct bigrams are counted.
BUCKET_CHARS = 20_000_000
#: Bigrams that a task holds before it deals them to buckets, and of these as many as it deals at once.
HELD, DEALT = 4_000_000, 1_000_000
#: Stands before the first word of a text.
START = np.int64(-1)
#: Stands for the second word of all bigrams that no model keeps.
REST = np.int32(-1)

_words = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _words(text.lower())


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts in a row: the text's number, the word's 64-bit hash, and the hash of the word before (START for the first)."""
    lists = [words(t) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, unique = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    word = pd.util.hash_array(unique, categorize=False).view(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    before = np.concatenate([[START], word[:-1]])[: len(word)]
    starts = np.cumsum(n) - n
    before[starts[n > 0]] = START
    return np.repeat(np.arange(len(lists)), n), word, before


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def discounts(count: np.ndarray, both: np.ndarray, part: float, spread: float) -> np.ndarray:
    """What Kneser-Ney takes off a class's counts: all that chance explains, given the counts of both classes and the class's part of them.

    That is the expected count and `spread` standard deviations. The more often an expression is, the more of its count may
    be chance; a fixed discount would keep the noise of every common word, and a long text has many.
    """
    expected = both * part
    return np.minimum(count, expected + spread * np.sqrt(expected + 1))


@dataclass
class Grams:
    """Numbers of training documents by word (sorted hashes) and by bigram (places of its two words; the number of words stands for START).

    Bigrams of one document of a class at most, which every discount takes off whole, are added up by their first word: REST stands for their second.
    """

    words: np.ndarray
    word_counts: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pair_counts: np.ndarray


@dataclass
class KneserNey:
    """Both models as arrays over the training words and bigrams, by sorted hash.

    P_c(w|h) = (n_c(h,w) - D)/n_c(h) + b_c(h) P_c(w) and P_c(w) = (n_c(w) - D)/N_c + b_c P(w), where P(w) is the share of
    the distinct bigrams of all documents that end in w, which both classes back off to, D are the discounts and b the
    mass that they free. Kept are log-ratios toxic over ordinary: of each word, of the backoff weight of each history, and
    what a bigram adds to its word's if any of its count is left; else that is the backoff weight's.
    """

    words: np.ndarray
    word: np.ndarray
    follow: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, grams: Grams, ends: np.ndarray, toxic: int, ordinary: int, spread: float) -> KneserNey:
        """Fits on two columns of the counts. ends: distinct bigrams of all documents by the word they end in, last those of unknown words.

        The last entry of each array over words stands for a word that no training document has, and as a history for
        the start of a text; a history that no document has backs off alike in both models.
        """
        size = len(grams.words)
        share = (ends + 0.5) / (ends + 0.5).sum()
        columns, total = [toxic, ordinary], grams.word_counts.sum(0)
        words = np.append(grams.word_counts[:, columns], np.zeros((1, 2), np.int32), 0)
        models, log_word, log_follow, kept = [], np.zeros(size + 1), np.zeros(size + 1), np.zeros(len(grams.before), bool)
        for sign, c in ((1, toxic), (-1, ordinary)):
            part = total[c] / max(1, total[columns].sum())
            n, m = grams.word_counts[:, c], grams.pair_counts[:, c]
            off = discounts(np.append(n, 0), words.sum(1), part, spread)
            less = np.where(grams.after == REST, m, discounts(m, grams.pair_counts[:, columns].sum(1), part, spread))
            p = (np.append(n, 0) - off + off.sum() * share) / n.sum() if n.any() else share  # a class without words backs off
            history = np.bincount(grams.before, m, size + 1)
            weight = np.where(history > 0, np.bincount(grams.before, less, size + 1) / np.maximum(history, 1), 1.0)
            kept |= m > less
            models.append((sign, m - less, p, history, weight))
            log_word, log_follow = log_word + sign * np.log(p), log_follow + sign * np.log(weight)
        first, second, log_pair = grams.before[kept], grams.after[kept], 0.0
        for sign, left, p, history, weight in models:
            log_pair = log_pair + sign * np.log(left[kept] / np.maximum(history[first], 1) + weight[first] * p[second])
        pair = (log_pair - log_word[second]).astype(np.float32)
        return cls(grams.words, log_word.astype(np.float32), log_follow.astype(np.float32), first.astype(np.int64) * (size + 1) + second, pair)

    def __getstate__(self) -> dict:
        """Small on its way to the tasks: histories as numbers of bigrams, ratios in half precision, compressed."""
        size = len(self.words) + 1
        small = self.__dict__ | {"pairs": (self.pairs % size).astype(np.int32), "starts": np.bincount(self.pairs // size, minlength=size).astype(np.int32), "pair": self.pair.astype(np.float16)}
        return {k: (zlib.compress(v.tobytes(), 1), v.dtype.str) if isinstance(v, np.ndarray) else v for k, v in small.items()}

    def __setstate__(self, state: dict) -> None:
        read = {k: np.frombuffer(zlib.decompress(v[0]), v[1]) if isinstance(v, tuple) else v for k, v in state.items()}
        size = len(read["words"]) + 1
        self.__dict__ |= {k: v for k, v in read.items() if k != "starts"}
        self.pairs = np.repeat(np.arange(size, dtype=np.int64) * size, read["starts"]) + read["pairs"]

    def ratio(self, doc: np.ndarray, word: np.ndarray, before: np.ndarray, count: int) -> np.ndarray:
        """For each of `count` texts the log-likelihood ratio of its words (see hashed_words) by the number of words; 0 without words."""
        size = len(self.words)
        place = lambda x: np.where(self.words[spot := np.minimum(np.searchsorted(self.words, x), size - 1)] == x, spot, size)
        w, h = place(word), place(before)
        real = (h < size) | (before == START)  # an unknown word has the place of START but is no history
        add = np.where(real, self.follow[h], 0)
        if len(self.pairs):
            keys = h * np.int64(size + 1) + w
            spot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            add = np.where((self.pairs[spot] == keys) & real, self.pair[spot], add)
        return np.bincount(doc, self.word[w] + add, count) / np.maximum(np.bincount(doc, minlength=count), 1)

    def score(self, texts) -> np.ndarray:
        z = self.offset + self.slope * self.ratio(*hashed_words(texts), len(texts)) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gram_counts(sample: DataFrame) -> Grams:
    """Counts of documents by word and bigram in four columns: toxic, ordinary, and both without the tuning quarter.

    First words, then bigrams as pairs of places in the vocabulary. The four counts travel in one long, 16 bits each,
    which holds for samples of fewer than 32,768 documents. Spark adds up; to the driver comes what the bounded sample has,
    without the bigrams that no model keeps: Spark adds those up by their first word, in longs.
    """

    def grams(vocabulary: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in (p for batch in batches for p in in_calls(batch)):
                doc, word, before = hashed_words(part["text"])
                if vocabulary is None:
                    gram = word
                else:
                    first = np.where(before == START, len(vocabulary), np.searchsorted(vocabulary, before))
                    gram = (first << np.int64(32)) | np.searchsorted(vocabulary, word)
                order = np.lexsort((doc, gram))
                gram, doc = gram[order], doc[order]
                once = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])) if len(gram) else np.zeros(0, bool)
                kind = (part["toxic"].to_numpy() == 0) * 1 + (part["tuning"].to_numpy() == 1) * 2
                marks = np.array([1 + (1 << 32), (1 << 16) + (1 << 48), 1, 1 << 16])  # toxic, ordinary, and the same without the tuning quarter
                yield pd.DataFrame({"gram": gram[once], "n": marks[kind[doc[once]]]})

        counted = sample.select("text", "toxic", "tuning").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = [F.shiftright("n", 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int").alias(f"n{i}") for i in range(4)]
        if vocabulary is not None:
            once = F.col("n").bitwiseAND(F.lit(~0x0001000100010001)) == 0
            key = F.when(once, F.col("gram").bitwiseOR(F.lit(0xFFFFFFFF))).otherwise(F.col("gram"))
            counted, counts = counted.groupBy(key.alias("gram")).agg(*(F.sum(c).cast("int").alias(f"n{i}") for i, c in enumerate(counts))), [f"n{i}" for i in range(4)]
        found = counted.select("gram", *counts).toArrow()
        gram = found["gram"].to_numpy()
        order = np.argsort(gram)
        gram, n = gram[order], np.empty((len(order), 4), np.int32)
        for i in range(4):
            n[:, i] = found[f"n{i}"].to_numpy()[order]
        return gram, n

    words, word_counts = grams(None)
    pairs, pair_counts = grams(words)
    return Grams(words, word_counts, (pairs >> 32).astype(np.int32), pairs.astype(np.int32), pair_counts)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, by byte plane."""
    return zlib.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of the arrays, sorted; the list is emptied, and one copy of the numbers is sorted where it lies."""
    values = np.concatenate(held)
    held.clear()
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _dealt(held: list[np.ndarray], buckets: int) -> Iterator[pd.DataFrame]:
    """The distinct bigrams of the arrays, packed by bucket, a stretch of them at a time; the list is emptied."""
    pairs = _distinct(held)
    for start in range(0, len(pairs), DEALT):
        own = pairs[start : start + DEALT]
        bucket = (own % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield pd.DataFrame({"bucket": bucket[cuts].astype(np.int64), "pairs": [_packed(x) for x in np.split(own, cuts[1:])]})


def continuations(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """The number of distinct bigrams of all documents that end in each word of the sorted vocabulary; last, those that end in other words.

    A bigram is a 64-bit number: the place of its word, and 40 bits of a hash of its two words. A task sets aside what it
    has met already and deals the others by that hash into buckets, which are packed for the shuffle; a bucket is merged
    in one task. There are as many buckets as keep one at a few million bigrams, however long the texts, and no word can crowd one.
    """
    size, texts = len(vocabulary), docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if size >= 1 << 24:
        raise ValueError("more training words than the place in a bigram's number can tell apart")
    buckets = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for part in (p for batch in batches for p in in_calls(batch)):
            _, word, before = hashed_words(part["text"])
            if not len(word):
                continue
            spot = np.minimum(np.searchsorted(vocabulary, word), size - 1)
            place = np.where(vocabulary[spot] == word, spot, size)
            with np.errstate(over="ignore"):
                mark = _mix(_mix(before) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)) >> np.uint64(24)
            held.append(np.unique((place.astype(np.uint64) << np.uint64(40)) | mark))
            count += len(held[-1])
            if count > HELD:
                yield from _dealt(held, buckets)
                count = 0
        if held:
            yield from _dealt(held, buckets)

    def merge(packed: pd.DataFrame) -> pd.DataFrame:
        word = (_distinct([_unpacked(x) for x in packed["pairs"]]) >> np.uint64(40)).astype(np.int32)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return pd.DataFrame({"word": word[first], "n": np.diff(first, append=len(word)).astype(np.int64)})

    merged = texts.mapInPandas(deal, "bucket long, pairs binary").groupBy("bucket").applyInPandas(merge, "word int, n long")
    found = merged.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashed words of each text; texts are numbered within a part. A text without words is a row with nulls."""
    for part in (p for batch in batches for p in in_calls(batch)):
        doc, word, before = hashed_words(part["text"])
        number = int(uuid.uuid4().int >> 65)
        rows = pd.DataFrame({"doc": doc, "word": pd.array(word, "Int64"), "before": pd.array(before, "Int64")})
        bare = pd.DataFrame({"doc": np.setdiff1d(np.arange(len(part)), doc)})
        rows = pd.concat([rows, bare.assign(word=pd.array([pd.NA] * len(bare), "Int64"), before=pd.array([pd.NA] * len(bare), "Int64"))])
        yield rows.assign(toxic=part["toxic"].to_numpy()[rows["doc"]], part=number)[["toxic", "doc", "word", "before", "part"]]


def _tuning_words(tokens) -> tuple[np.ndarray, tuple]:
    """Labels of the tuning documents, and the arguments of ratio()."""
    part, doc = pd.factorize(tokens["part"].to_numpy())[0], tokens["doc"].to_numpy()
    _, first, doc = np.unique(part * (doc.max(initial=0) + np.int64(1)) + doc, return_index=True, return_inverse=True)
    real = tokens["word"].is_valid().to_numpy()
    column = lambda c: tokens[c].fill_null(0).to_numpy()[real]
    return tokens["toxic"].to_numpy()[first].astype(float), (doc.reshape(-1)[real], column("word"), column("before"), len(first))


def calibrate(ratio: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a weighted logistic regression of the labels on the ratio, and its loss; the slope is never negative.

    Texts are put in an order of their own first, so that sums do not depend on partitions.
    """
    order = np.lexsort((ratio, toxic))
    ratio, toxic, weight = ratio[order], toxic[order], weight[order]
    spread = max(ratio.std(), 1e-9)
    x, beta = np.column_stack([ratio / spread, np.ones(len(ratio))]), np.zeros(2)
    free = np.array([ratio.std() > 1e-9, True])
    while True:
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
            step = np.where(free, np.linalg.solve(np.where(np.outer(free, free), bend, np.eye(2)), np.where(free, x.T @ (weight * (toxic - p)) - RIDGE * beta, 0)), 0)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if beta[0] >= 0:
            break
        free, beta = np.array([False, True]), np.zeros(2)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return float(beta[0] / spread), float(beta[1]), float(-(weight * np.where(toxic == 1, np.log(p), np.log(1 - p))).sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KneserNey | float:
    """Models fitted on labelled documents whose crc32(doc_id as text) mod 5 is not 0; a fixed score if a class has none.

    Of each class the documents that come first by a hash of the id are taken, up to TOXIC_DOCS and ORDINARY_DOCS; this
    bound holds at any corpus size, so their ids may be broadcast. Every word and bigram of them keeps its counts, however
    rare; the backoff counts come from all documents. Equal texts of a class count once; an id with both labels takes no
    part. A quarter of them (remainder 1) tunes: under models of the other three quarters it chooses the discount of SPREADS with the
    least loss, and one slope and one offset that turn the ratio to a probability, weighted to the classes' shares among
    all labels. The score is a monotone function of the ratio of models of all four.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    marked = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (remainder != 0)).groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.min(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("toxic").cast("int")).alias("most")).filter("toxic = most").drop("most")
    )
    shares = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return float(bool(shares.get(1)))
    drawn = [marked.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))]
    sample = (
        id_text(docs, id_col, text_col).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
        .dropDuplicates(["text", "toxic"]).withColumn("tuning", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).cast("int"))
    )
    sample = table(sample, "toxicity-sample")
    n = {(r["toxic"], r["tuning"]): r["count"] for r in sample.groupBy("toxic", "tuning").count().collect()}
    if not n.get((1, 0)) or not n.get((0, 0)):
        return shares[1] / sum(shares.values())
    grams = _gram_counts(sample)
    if not len(grams.words):
        return shares[1] / sum(shares.values())
    ends = continuations(docs, grams.words, text_col)
    y, tuning = _tuning_words(sample.filter("tuning = 1").mapInPandas(_tokens, "toxic int, doc int, word long, before long, part long").toArrow())
    if len(set(y)) < 2:
        return KneserNey.fit(grams, ends, 0, 1, SPREADS[0])
    share = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    tries = [(calibrate(KneserNey.fit(grams, ends, 2, 3, spread).ratio(*tuning), y, share * len(y) / share.sum()), spread) for spread in SPREADS]
    (slope, offset, _), spread = min(tries, key=lambda t: (round(t[0][2], 6), t[1]))
    model = KneserNey.fit(grams, ends, 0, 1, spread)
    model.slope, model.offset = slope, offset
    return model


def score_toxicity(docs: DataFrame, model: KneserNey | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Only the text decides the score.

    The text's words are scored by both models; the difference of the log-likelihoods, divided by the number of words, is
    turned to a probability by one slope and one offset. The model has every word of the training documents, and every bigram that is more frequent in a class than chance explains. Nothing is shuffled. Null and empty
    texts, and texts without letters, have ratio 0 and the score that belongs to it; held_out is false for a null id;
    repeated rows and an empty table give what is to be expected; other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = id_text(docs, id_col, text_col).select("doc_id", held_out.alias("held_out"), toxicity(model, F.col("text"), docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(model: KneserNey | float, text: Column, spark: SparkSession) -> Column:
    """The score as a column. The model's size is bounded by its training sample."""
    if isinstance(model, float):
        return F.lit(model)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.concatenate([sent.value.score(t[i : i + ROWS_PER_CALL]) for i in range(0, len(t), ROWS_PER_CALL)]) if len(t) else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
