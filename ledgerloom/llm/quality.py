"""Document quality by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_calls, read

#: Rows that the classifiers are fitted on, at most: labelled ones, and unlabelled ones that get pseudo-labels.
LABELLED, UNLABELLED = 6_000, 6_000
#: Rounds of exchange, and the pseudo-labels that a view hands over for each class in a round, as a share of the pool.
ROUNDS, HANDED = 5, 0.03
#: What a view must be sure of a pseudo-label, by its calibration: probability, and log-odds beyond those of the class's share.
SURE, BEYOND = 0.9, 2.0
#: Log-likelihood of the tuning rows that a view must gain over the class's share in order to count, and with the labels of a
#: round in order to keep them: the one in a hundred point of chance, as five rounds try.
GAIN = 3.32
#: Buckets for hashed metadata values, and for hashed words.
BUCKETS, WORD_BUCKETS = 64, 128

_KINDS = np.full(256, 7)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b".,;:'\"-?()", b"#$%&*|!<>{}[]@^~_=+/\\", b"\n")):
    _KINDS[list(_chars)] = _k


def text_views(texts) -> np.ndarray:
    """For each text its words by hashed bucket (roots of their shares), shares of eight kinds of bytes, repetition of words and lines, word length and length."""
    lists = [t.split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, unique = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
    bucket = (pd.util.hash_array(unique, categorize=False) % np.uint64(WORD_BUCKETS)).astype(np.int64)[codes] if len(codes) else codes
    words = np.bincount(np.repeat(np.arange(len(lists)), n) * WORD_BUCKETS + bucket, minlength=len(lists) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
    out = np.zeros((len(lists), 13))
    for i, (text, ws) in enumerate(zip(texts, lists)):
        raw = np.frombuffer(text.encode(), np.uint8)
        lines, distinct = text.split("\n"), len(set(ws))
        out[i, :8] = np.bincount(_KINDS[raw], minlength=8) / max(1, len(raw))
        # repetition beyond what a text of this length has: natural texts keep about n ** 0.8 distinct words or more
        out[i, 8:] = distinct / max(1, len(ws)), np.log1p(distinct) - 0.8 * np.log1p(len(ws)), len(set(lines)) / len(lines), min(len(text) / max(1, len(ws)), 40.0) / 10, np.log1p(len(ws))
    return np.concatenate([out, np.sqrt(words / np.maximum(n, 1)[:, None])], 1)


def metadata_view(lang, source, n_chars) -> np.ndarray:
    """Hashed language and source, and the stated length; nulls have values of their own."""
    out = np.zeros(2 * BUCKETS + 12)
    out[crc32(f"lang {lang}".encode()) % BUCKETS] = 1
    out[BUCKETS + crc32(f"source {source}".encode()) % BUCKETS] = 1
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, float(n_chars))) if known else 0.0
    out[2 * BUCKETS + (int(min(9, size)) if known else 10)] = 1
    out[-1] = size / 5
    return out


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1], -15, 15)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Linear:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
        beta, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -15, 15)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
            beta = beta + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)


@dataclass
class CoTrained:
    """Both views' classifiers, each with its calibration, and the log-odds of a good document.

    The views are combined by what each adds to those log-odds, so a view whose calibration is flat adds nothing.
    """

    text: Linear
    metadata: Linear
    calibrations: tuple[Linear, Linear]
    prior: float

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibrations[0].logit(self.text.logit(text)[:, None])
        b = self.calibrations[1].logit(self.metadata.logit(metadata)[:, None])
        return tuple(1 / (1 + np.exp(-x)) for x in (a, b, a + b - self.prior))


def _loss(model: Linear, x: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -1, 1) * model.logit(x)).sum())


def calibrated(logits: np.ndarray, y: np.ndarray) -> Linear:
    """A view's logits turned to log-odds; constant, those of the class's share, unless the view tells the labels apart by more than chance (GAIN)."""
    found, share = Linear.fit(logits, y, 1.0), y.mean()
    flat = Linear(np.zeros(1), np.ones(1), np.array([0.0, np.log(share / (1 - share))]))
    return found if found.beta[0] > 0 and _loss(found, logits, y) + GAIN <= _loss(flat, logits, y) else flat


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, tuning: np.ndarray, pools: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """Each round, each view labels the pool rows it is surest of for the other view.

    The tuning rows, which no view is fitted on, say how sure a view is: its calibrated probability there must reach SURE
    and pass the class's own share by BEYOND in log-odds, so a view that tells nothing hands over nothing. A view that does not
    fit the tuning rows better by more than chance (GAIN) with the labels of a round does without them. The tuning rows calibrate.
    """
    fit, known = ~tuning, y[tuning]
    xs, ys = [v[fit] for v in views], [y[fit], y[fit]]
    free, share = np.ones(len(pools[0]), bool), np.log(known.mean() / (1 - known.mean()))
    logits = lambda v: models[v].logit(views[v][tuning])[:, None]
    models = [Linear.fit(x, t) for x, t in zip(xs, ys)]
    calibrations = [calibrated(logits(v), known) for v in (0, 1)]
    for _ in range(rounds):
        handed = []
        for v in (0, 1):
            left = np.flatnonzero(free)
            z = calibrations[v].logit(models[v].logit(pools[v][left])[:, None])
            k, sure = max(1, int(HANDED * len(free))), np.log(SURE / (1 - SURE))
            order = np.argsort(z, kind="stable")
            best, worst = order[::-1][:k], order[:k]
            best, worst = best[z[best] > max(sure, share + BEYOND)], worst[z[worst] < min(-sure, share - BEYOND)]
            handed.append((left[best], left[worst]))
        for v, (best, worst) in enumerate(handed):
            free[best] = free[worst] = False
            other = 1 - v
            if not len(best) + len(worst):
                continue
            x = np.concatenate([xs[other], pools[other][best], pools[other][worst]])
            t = np.concatenate([ys[other], np.ones(len(best)), np.zeros(len(worst))])
            before, models[other] = models[other], Linear.fit(x, t)
            again = calibrated(logits(other), known)
            if _loss(again, logits(other), known) + GAIN <= _loss(calibrations[other], before.logit(views[other][tuning])[:, None], known):
                xs[other], ys[other], calibrations[other] = x, t, again
            else:
                models[other] = before
    return CoTrained(models[0], models[1], tuple(calibrations), float(share))


def _views(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return text_views([t or "" for t in b["text"]]), np.stack([metadata_view(*r) for r in zip(b["lang"], b["source"], b["n_chars"])])


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | float:
    """A model from labelled rows whose crc32(doc_id as text) mod 5 is not 0 (those with 0 are left for testing).

    Bounded samples by a hash of the id: LABELLED labelled and UNLABELLED unlabelled rows, whose ids may be broadcast
    and whose feature vectors, not texts, come to the driver. An id with both labels takes no part. A quarter of the
    labelled ones tunes: it says how sure a view is and calibrates. Without both classes, a fixed score: the share of good labels, or 1 without labels.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc % 5 != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("quality").cast("int")).alias("most")).filter("quality = most").drop("most")
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = _columns(docs)
    pool = rows.select("doc_id").filter(F.col("doc_id").isNotNull()).join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    wanted = drawn.unionByName(pool.withColumn("quality", F.lit(-1))).dropDuplicates(["doc_id"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_calls(batch):
                text, metadata = _views(b)
                yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "text": list(text), "metadata": list(metadata)})

    got = rows.join(F.broadcast(wanted), "doc_id").mapInPandas(features, "doc_id long, quality int, text array<double>, metadata array<double>").toPandas().sort_values("doc_id", kind="stable")
    labelled, unlabelled = got[got["quality"] >= 0], got[got["quality"] < 0]
    y = labelled["quality"].to_numpy(float)
    tuning = np.array([crc32(f"tuning {i}".encode()) % 4 == 0 for i in labelled["doc_id"]], bool)
    if len(y) == 0 or len(set(y[tuning])) < 2 or len(set(y[~tuning])) < 2:
        return float(y.mean()) if len(y) else 1.0
    stack = lambda rows, c, like: np.stack(list(rows[c])) if len(rows) else np.zeros((0, len(like[c].iloc[0])))
    return co_train(tuple(stack(labelled, c, labelled) for c in ("text", "metadata")), y, tuning, tuple(stack(unlabelled, c, labelled) for c in ("text", "metadata")))


def score_quality(docs: DataFrame, model: CoTrained | float) -> DataFrame:
    """One row per input row: doc_id, text_score, metadata_score, score (probability that the document is good), keep (score >= 0.5).

    Features and scores are computed in one pass over whole texts without a shuffle. Null texts count as empty, null
    metadata as a value of its own; repeated rows score alike; an empty table gives an empty result; columns other than
    doc_id, text, lang, source and n_chars are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in in_calls(batch):
                parts = [np.full(len(b), model)] * 3 if isinstance(model, float) else model.scores(*_views(b))
                yield pd.DataFrame({"doc_id": b["doc_id"], "text_score": parts[0], "metadata_score": parts[1], "score": parts[2]})

    return _columns(docs).mapInPandas(run, "doc_id long, text_score double, metadata_score double, score double").withColumn("keep", F.col("score") >= 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
QUERIES = {"op2_quality": op2_quality}
