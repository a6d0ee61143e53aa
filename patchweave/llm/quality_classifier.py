"""A quality classifier learned from trusted positives and unlabelled text.

The model is linear in shares of bytes and of pairs of byte kinds and in a few
shape statistics of the whole text.  It minimises the non-negative unbiased risk of positive-unlabelled
learning::

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

where the positives are documents labelled 1, the unlabelled set is a sample of
the whole web text (labels hidden), and the class prior is estimated as the
share of label 1 among labelled documents.  Only rows whose crc32(doc_id) mod 4
is not 2 are learned from.

Fitting uses bounded samples (``positives``, ``unlabelled`` ids, lowest hash of
the id; of the rows that repeat an id the one with the least vector counts); every
row is scored.  Null or empty text: scored like an empty text.
Labels that contradict each other for an id are ignored.  No positives to learn
from: score 0.5 for all.  Repeated rows: one result each; empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, held_out, map_arrow, session, table

POSITIVES = 8_000
UNLABELLED = 16_000
STATS = 4
WIDTH = 256 + 81 + STATS
THRESHOLD = 0.7


class Features:
    """Shares of bytes (256), of pairs of byte kinds (81), and STATS shape statistics of a text."""

    def __init__(self):
        from .shingles import Hasher

        self.hasher = Hasher(lower=False)
        kind = np.zeros(256, np.uint8)
        kind[ord("a") : ord("z") + 1] = 1
        kind[ord("A") : ord("Z") + 1] = 2
        kind[ord("0") : ord("9") + 1] = 3
        kind[[9, 10, 11, 12, 13, 32]] = 4
        for c in b"#*$%&|<>":
            kind[c] = 5
        for c in b".,;:?'\"()-":
            kind[c] = 6
        kind[128:] = 7
        kind[ord("!")] = 8
        self.kind = kind

    def __call__(self, text: str) -> np.ndarray:
        data = text.encode()
        b = np.frombuffer(data, np.uint8)
        out = np.zeros(WIDTH, np.float32)
        n = len(b)
        if n == 0:
            return out
        out[:256] = np.sqrt(np.bincount(b, minlength=256) / n)
        if n > 1:
            kinds = self.kind[b]
            out[256:337] = np.sqrt(np.bincount(kinds[:-1] * np.uint8(9) + kinds[1:], minlength=81) / (n - 1))
        words = self.hasher.words(data)
        m = len(words)
        triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if m > 2 else words[:0]
        fresh = len(np.unique(triples)) / len(triples) if len(triples) else 1.0
        same = float(np.mean(words[1:] == words[:-1])) if m > 1 else 0.0
        out[337:] = [np.log1p(m) / 10, fresh, same, n / max(m, 1) / 20]
        return out


def _vectors():
    import pyarrow as pa

    features = Features()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [features(t or "").astype(np.float16).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["doc_id", "x"])

    return run


def _scores(weights: np.ndarray, bias: float):
    def make():
        import pyarrow as pa

        features = Features()

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    x = np.array([features(t or "") for t in part.column(1).to_pylist()])
                    z = np.clip(x @ weights + bias, -30, 30)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "held_out", "score"])

        return run

    return make


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risks(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the unbiased risk for weights and bias ``w`` under the sigmoid loss: what positives and what negatives cost."""
    sp, su = _sigmoid(xp @ w[:-1] + w[-1]), _sigmoid(xu @ w[:-1] + w[-1])
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean()


def _mean(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.concatenate([x.T @ g, [g.sum()]]) / len(g)


def descent(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """The gradient that non-negative learning follows: that of both parts, the second reversed while it is below zero."""
    sp, su = _sigmoid(xp @ w[:-1] + w[-1]), _sigmoid(xu @ w[:-1] + w[-1])
    slope = prior * _mean(xp, sp * (1 - sp))
    negative = _mean(xu, su * (1 - su)) - slope
    return -slope + (negative if su.mean() >= prior * sp.mean() else -negative)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = x - mean  # the one copy
    x /= scale
    return np.clip(x, -8, 8, out=x).astype(np.float32, copy=False)


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, warm: int = 120, rounds: int = 150, rate: float = 0.03, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias on unscaled features.

    Full-batch Adam: a logistic start that tells positives from the unlabelled, its bias set where the prior's
    share of the unlabelled lies above, then descent on the non-negative risk with the (bounded) sigmoid loss.
    """
    mean, scale = xu.mean(0), xu.std(0) + 0.02 * np.sqrt(np.maximum(xu.mean(0), 1e-6)) + 1e-4
    xp, xu = (_scaled(x, mean, scale) for x in (xp, xu))
    w = np.zeros(xp.shape[1] + 1, np.float32)

    def follow(gradient, w, steps):
        m = v = 0.0
        for step in range(1, steps + 1):
            grad = gradient(w)
            grad[:-1] += np.float32(ridge) * w[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = (w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return w

    w = follow(lambda w: _mean(xp, _sigmoid(xp @ w[:-1] + w[-1]) - 1) + _mean(xu, _sigmoid(xu @ w[:-1] + w[-1])), w, warm)
    w[-1] -= np.quantile(xu @ w[:-1] + w[-1], 1 - prior)
    w = follow(lambda w: descent(w, xp, xu, prior), w, rounds)
    weights = (w[:-1] / scale).astype(np.float64)
    return weights, float(w[-1] - mean @ weights)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Fit on the learning folds; None without positives."""
    learn = F.coalesce(crc_fold() != 2, F.lit(False))
    known = labels.filter(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    share = known.agg(F.avg("lo").alias("p")).first().p
    if not share:
        return None
    prior = min(max(float(share), 0.02), 0.98)
    order = F.xxhash64("doc_id", F.lit(8))

    def vectors(ids: DataFrame) -> np.ndarray:
        # the ids are a sample of fixed size
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
        one = map_arrow(text, lambda: _vectors(), "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
        raw = bytearray()
        for r in one.orderBy("doc_id").select("x").toLocalIterator():
            raw += r.x
        return np.frombuffer(raw, np.float16).reshape(-1, WIDTH).astype(np.float32)

    xp = vectors(known.filter("lo = 1").select("doc_id").orderBy(order, "doc_id").limit(positives))
    xu = vectors(docs.filter(learn).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(order, "doc_id").limit(unlabelled))
    if not len(xp) or not len(xu):
        return None
    return fit(xp, xu, prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, **sizes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = map_arrow(rows, _scores(*model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _accepting(weights: np.ndarray, bias: float, threshold: float, column: int):
    def make():
        import pyarrow as pa

        features = Features()

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    x = np.array([features(t or "") for t in part.column(column).to_pylist()])
                    z = np.clip(x @ weights + bias, -30, 30)
                    yield part.filter(pa.array(1 / (1 + np.exp(-z)) >= threshold))

        return run

    return make


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sizes) -> DataFrame:
    """The rows, whole, that the classifier predicts 1; all of them where nothing could be learned."""
    model = train(docs, labels, **sizes)
    if model is None:
        return docs
    return map_arrow(docs, _accepting(*model, threshold, docs.columns.index("text")), docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
