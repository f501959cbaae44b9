"""Quality classifier: a support vector machine over naive Bayes features.

A text's features are indicators of n-grams: its tokens (runs of letters, of capitals, of digits or of punctuation) and
the sequences of two and three token shapes, hashed into 2 ** BITS places. Each indicator is scaled by the log ratio of
its smoothed frequencies in the two classes; a linear hinge-loss model is fitted to the unit-length scaled vectors by
dual coordinate descent, and a logistic curve over its margins, fitted to rows kept out of that fit, makes the score.

It learns from a bounded sample (at most SAMPLE labelled rows, those with the smallest hash of doc_id, and at most
SAMPLE_MB of their features, whatever the corpus' size and its texts' length); the features of those rows are all that
reaches the driver. Scoring is one pass over the corpus.

Cases: null and empty texts have no features and get the score of the model's intercept; long texts are taken whole; rows
whose label is null, or whose doc_id has contradicting labels, teach nothing; rows of one hash are ordered by doc_id, then
by their features; without rows of both classes every score is the share of label 1 (0.5 without any); repeated rows are
scored alike; an empty corpus gives no rows; other columns pass through unread, one of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, table, written
from .text_arrays import chunks, hashes, lowered, mix, runs

#: Size of the feature space, rows learnt from, cost of an error, rounds of the descent, score from which a text is good.
BITS, SAMPLE, COST, ROUNDS, GOOD = 18, 8000, 1.0, 20, 0.7

#: MB of features, beside SAMPLE rows, that the model learns from.
SAMPLE_MB = 100

_KINDS = np.array([0 if b <= 32 or b == 127 else 1 if 97 <= b <= 122 or b > 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 for b in range(256)], np.uint8)


def features(texts: list, bits: int = BITS) -> list[np.ndarray]:
    """The sorted, different feature numbers of each text."""
    found: list[np.ndarray] = []
    for _, data, begins in chunks(texts):
        kinds = _KINDS[data]
        starts, ends = runs(kinds)
        n = len(begins) - 1
        if not len(starts):
            found += [np.zeros(0, np.int32)] * n
            continue
        doc = np.searchsorted(begins, starts, "right") - 1
        token = hashes(lowered(data), starts, ends)
        kind, length = kinds[starts].astype(np.uint64), np.minimum(ends - starts, 3).astype(np.uint64)
        shape = np.where(kind == 4, token, mix(kind * np.uint64(8) + np.where(kind == 2, np.minimum(length, 2), 0).astype(np.uint64) + np.uint64(101)))
        shape = shape + np.concatenate([[True], starts[1:] > ends[:-1]]).astype(np.uint64)  # is there space before it?
        grams = [mix(token ^ np.uint64(1))]
        docs = [doc]
        run = shape
        for step in (1, 2):
            run = mix(run[: len(shape) - step] * np.uint64(31) + shape[step:]) if len(shape) > step else run[:0]
            same = doc[: len(run)] == doc[len(doc) - len(run) :]
            grams.append(mix(run[same] ^ np.uint64(step + 1)))
            docs.append(doc[: len(run)][same])
        both = np.concatenate(docs).astype(np.uint64) << np.uint64(32) | np.concatenate(grams) >> np.uint64(64 - bits)
        both = np.unique(both)
        cut = np.searchsorted(both >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        number = (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
        found += [number[cut[i] : cut[i + 1]] for i in range(n)]
    return found


@dataclass
class Model:
    """A linear model over feature numbers: the score of a text is 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray  # of the scaled, unit-length features
    ratios: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        norm = float(np.sqrt(r @ r)) or 1.0
        return float(self.weights[x] @ r) / norm + self.intercept

    def scores(self, texts: list) -> np.ndarray:
        margins = np.array([self.margin(x) for x in features(texts, int(np.log2(len(self.ratios))))])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    """The log of the ratio of each feature's smoothed shares in class 1 and class 0."""
    counts = [np.bincount(np.concatenate([x for x, v in zip(rows, y, strict=True) if v == c]), minlength=1 << bits) + 1.0 for c in (1, 0)]
    shares = [c / c.sum() for c in counts]
    return np.log(shares[0] / shares[1]).astype(np.float32)


def descend(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and intercept (a feature that is always 1)."""
    w, b, alpha, sign = np.zeros(size), 0.0, np.zeros(len(y)), np.where(y == 1, 1.0, -1.0)
    square = np.array([float(v @ v) + 1.0 for _, v in vectors])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = vectors[i]
            gradient = sign[i] * (float(w[x] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w[x] += step * sign[i] * v
                b += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the margins, by Newton's method on Platt's smoothed targets."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, np.log((good + 1) / (bad + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -500, 500)))
        g, q = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[q @ margins**2 + 1e-6, q @ margins], [q @ margins, q.sum() + 1e-6]])
        da, dc = np.linalg.solve(h, [g @ margins, g.sum()])
        a, c = a - np.clip(da, -5, 5), c - np.clip(dc, -5, 5)
        if abs(da) + abs(dc) < 1e-9:
            break
    return float(a), float(c)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, cost: float = COST, rounds: int = ROUNDS) -> Model:
    """A model of labelled rows of feature numbers. Every fifth row only sets the logistic curve."""
    share = float(y.mean()) if len(y) else 0.5
    for_curve = np.arange(len(y)) % 5 == 4
    if len(set(y[~for_curve])) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(1 << bits, np.float32)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    ratios = log_ratios([x for x, k in zip(rows, for_curve, strict=True) if not k], y[~for_curve], bits)

    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = ratios[x].astype(float)
        return x, r / (np.sqrt(r @ r) or 1.0)

    w, b = descend([scaled(x) for x, k in zip(rows, for_curve, strict=True) if not k], y[~for_curve], 1 << bits, cost, rounds)
    model = Model(w.astype(np.float32), ratios, b, 1.0, 0.0)
    kept = for_curve if len(set(y[for_curve])) == 2 else np.ones(len(y), bool)
    model.slope, model.shift = calibrate(np.array([model.margin(x) for x, k in zip(rows, kept, strict=True) if k]), y[kept])
    return model


def held_out(doc_id: Column) -> Column:
    """Is the row in the fourth of the corpus whose labels are never learnt from?"""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fits a model to at most `sample` rows of documents(doc_id, text) that labels(doc_id, quality) marks."""
    marked = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2")
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    rows = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most `sample` rows of two numbers

    def numbers(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [x.tobytes() for x in features(pdf["text"].tolist(), bits)]})
        give_back()

    found = written(rows.mapInPandas(numbers, "doc_id long, y int, x binary").withColumn("h", F.xxhash64("doc_id")), "sample")
    sizes = [r[0] for r in found.select("h", "doc_id", "x", F.octet_length("x").alias("n")).orderBy("h", "doc_id", "x").limit(sample).select("n").collect()]
    most = int(np.searchsorted(np.cumsum(sizes), SAMPLE_MB << 20, "right"))
    found = found.orderBy("h", "doc_id", "x").limit(most).collect()
    return fit([np.frombuffer(r["x"], np.int32) for r in found], np.array([r["y"] for r in found], int), bits)


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents with the model's score of each text added."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, twice

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shipped.value.scores(texts.tolist()))
        give_back()

    return documents.withColumn(name, scores(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
