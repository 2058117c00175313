"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios, trained on labelled texts.

Features are the distinct character n-grams (code points, A-Z lower-cased) of a whole text, hashed into 2**bits bins.
Log-count ratios come from counts over every labelled training row, summed by Spark. Logistic weights over the scaled
features are fitted on a bounded sample of those rows: the `max_train` rows least by hashes of their id and text, equal rows
once (a documented parameter). Every text is then scored in Arrow batches with the weights, 2**bits floats, broadcast.

Cases: null and empty texts have no feature and get the score of the bias; rows without a label, or with a null label,
are not trained on; several labels of a document count each; with no labels of one class every score is the share of
label 1; a row with a null id is not held out; an empty table gives an empty result; other columns are ignored. Labels, lang, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import map_texts
from quarry.llm.shared import bound_batches, stage

ORDERS = (3, 4, 5)
BITS = 19
#: Labelled rows up to so many are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_LABELS = 1_000_000
#: Fixed odd multipliers of the n-gram hash, one a position.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class Grams:
    """The distinct n-gram bins of a text. Keeps a scratch table, so that no sort is needed."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> None:
        self.orders, self.bits = orders, bits
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        x = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.zeros(0, np.uint32)
        x = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint64)
        x[(x >= 9) & (x <= 13)] = 32
        bins, h = [], np.zeros(len(x), np.uint64)
        for k in range(max(self.orders)):
            if len(x) <= k:
                break
            h = h[: len(x) - k] + x[k:] * np.uint64(MULTIPLIERS[k])
            if k + 1 in self.orders:
                mixed = h * np.uint64(MULTIPLIERS[-1 - k % 3])
                bins.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(MULTIPLIERS[0]) >> np.uint64(64 - self.bits)).astype(np.int64))
        if not bins:
            return np.zeros(0, np.int64)
        ids = np.concatenate(bins)
        at = np.arange(len(ids), dtype=np.int32)
        self.last[ids] = at
        return ids[self.last[ids] == at]


def fit(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, epochs: int = 6, rate: float = 0.25, l2: float = 1e-6, seed: int = 42) -> np.ndarray:
    """Weights of the bins (the ratio multiplied in), the bias last: AdaGrad over the rows in a seeded order. Deterministic."""
    w, g2, b2 = np.zeros_like(ratio), np.full(len(ratio), 1e-3), 1e-3
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if 0 < share < 1:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                f, y = rows[i]
                x = ratio[f] / np.sqrt(max(len(f), 1))
                err = 1 / (1 + np.exp(-np.clip(float(w[f] @ x) + bias, -30, 30))) - y
                g = err * x + l2 * w[f]
                g2[f] += g * g
                w[f] -= rate * g / np.sqrt(g2[f])
                b2 += err * err
                bias -= rate * err / np.sqrt(b2)
    return np.append(w * ratio, bias)


def log_ratio(marked: DataFrame, orders: tuple[int, ...], bits: int, alpha: float) -> np.ndarray:
    """Of each bin, the log of its share of class-1 texts over its share of class-0 texts, smoothed by alpha texts of the usual mix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sums, n = Grams(orders, bits), np.zeros((2, (1 << bits) + 1), np.int64), [0, 0]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                sums[y, get(text)] += 1
                n[y] += 1
        sums[:, -1] = n
        used = np.flatnonzero(sums.any(0))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], ["bin", "n0", "n1"])

    counts = marked.select("text", "y").mapInArrow(count, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    sums = np.zeros((2, (1 << bits) + 1))
    sums[:, counts["bin"].to_numpy(np.int64)] = counts[["n0", "n1"]].to_numpy(float).T
    n = np.maximum(sums[:, -1:], 1e-9)
    sums = (sums[:, :-1] + alpha * n / n.sum()) / n
    return np.log(sums[1]) - np.log(sums[0])


def train(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS, max_train: int = 6000, alpha: float = 30.0) -> np.ndarray:
    """The weights of 2**bits bins and the bias. labels: doc_id and y (0 or 1)."""
    spark = docs.sparkSession
    labels = stage(labels.select("doc_id", F.col("y").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null"), "toxic-labels")
    marked = docs.select("doc_id", "text").join(F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels, "doc_id")
    ratio = spark.sparkContext.broadcast(log_ratio(marked, orders, bits, alpha))
    keyed = marked.select(F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("h"), "y", "text")
    chosen = stage(keyed.select("k", "h", "y").distinct().orderBy("k", "h", "y").limit(max_train), "toxic-sample")
    # an id may be in many rows; of equal rows one is learnt from, so no more than max_train texts meet
    sample = keyed.join(F.broadcast(chosen), ["k", "h", "y"], "left_semi").dropDuplicates(["k", "h", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Grams(orders, bits)
        got = sorted((k, y, text or "") for b in batches for k, y, text in zip(*(b.column(c).to_pylist() for c in ("k", "y", "text")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(fit([(get(text).astype(np.int32), y) for _, y, text in got], ratio.value))], ["w"])

    w = sample.select("k", "y", "text").repartition(1).mapInArrow(learn, "w double").toPandas()["w"].to_numpy()
    return w if len(w) else np.append(np.zeros(1 << bits), 0.0)


def score(docs: DataFrame, weights: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def f(part: pa.RecordBatch) -> dict:
        get, w = Grams(orders, bits), shared.value
        z = np.array([w[g].sum() / np.sqrt(max(len(g), 1)) + w[-1] for g in map(get, part.column("text").to_pylist())])
        return {"score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    return map_texts(docs, f, "score double", ["doc_id"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod 4 is 2 are held out of training."""
    bound_batches(docs.sparkSession)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = labels.where(~out).select("doc_id", F.col("toxic").alias("y"))
    scored = score(docs, train(docs, known, max_train=max_train))
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
