"""Quality scores by Bradley-Terry pairwise ranking.

Every document has a vector of surface features (repetition, symbols, shouting, separators, line ends,
lengths), each squashed to 0..1. Weights are learnt from preference pairs: a document labelled 1 is
preferred to one labelled 0, and the logistic loss of the difference of their scores is minimised on
the difference of their features. The decision threshold is the quantile of the sample's scores at
the share of documents labelled 0, and the reported score is a logistic of the distance to it, so that
it is at least ``CUT`` exactly at or above the threshold.

Labels are learnt from a bounded sample: at most ``sample_docs`` labelled documents, those with the smallest
hash of their id; ``PAIRS`` pairs are drawn from it. The model is a few dozen numbers.

Defined results: NULL text is empty, scored like any text; labels of unknown or NULL ids and NULL labels are
ignored; without both labels in the sample every score is 0.5; repeated rows get equal scores; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, PAIRS, STEPS, RATE, DECAY = 8000, 20_000, 400, 0.5, 1e-4
CUT = 0.3
SYMBOLS = "#*$%&|<>"
_KEEP = str.maketrans("", "", SYMBOLS)


def features(text: str | None) -> list[float]:
    """Features of a whole text, each between 0 and 1."""
    text = text or ""
    w = text.split()
    n, chars = max(1, len(w)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(w)
    stutter = sum(map(str.__eq__, w, w[1:])) / n
    grams = len(set(zip(w, w[1:], w[2:], strict=False)))
    x = [
        (len(text) - len(text.translate(_KEEP))) / chars,
        (text.count("!!") + text.count("??")) / n,
        sum(map(str.isupper, w)) / n,
        text.count(" | ") / n,
        stutter,
        1 - grams / max(1, len(w) - 2) if len(w) > 2 else 0.0,
        max(counts.values(), default=0) / n,
        sum(not x.rstrip().endswith((".", "!", "?", "…", '"', "”")) for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    squashed = [v / (v + 0.05) for v in x]
    return [*x, *squashed, min(1.0, np.log1p(len(w)) / 12), min(1.0, chars / n / 20), float(len(w) < 20)]


N_FEATURES = len(features(""))


class Ranking:
    """Weights on standardised features, threshold and scale of the reported score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.std
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
        for t in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            g = -(d * p[:, None]).mean(axis=0) + DECAY * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - RATE / 10 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w = w
        s = np.sort(z @ w)
        k = int(round((y == 0).mean() * len(s)))
        k = min(max(k, 1), len(s) - 1)
        self.threshold = (s[k - 1] + s[k]) / 2
        self.scale = 4 / (np.std(s) + 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.std) @ self.w
        return 1 / (1 + np.exp(np.clip(-self.scale * (s - self.threshold) - np.log(CUT / (1 - CUT)), -30, 30)))


def _features_of(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names[1:], "x"])

    d = docs.select(F.col(text_col).alias("_text"), *keep)
    return d.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[1:]) + ", x array<double>")


def sample_labels(labels: DataFrame, learn: Column, label: Column, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids with their label, those with the smallest hash of the id."""
    rows = labels.filter(learn & label.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), label.cast("int").alias("y"))
    return rows.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, seed: int = 0) -> Ranking | None:
    some = F.broadcast(sample_labels(labels, learn, F.col(label_col), id_col, sample_docs))  # at most sample_docs rows
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(some, "_id")
    rows = _features_of(joined, "text", [F.col("_id").cast("string").alias("_id"), F.col("y")]).orderBy("_id").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return Ranking(np.array([r["x"] for r in rows]), y, seed)


def score(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text", *carry: Column) -> DataFrame:
    """Per row: ``doc_id``, the columns of ``carry``, ``score`` and ``predicted``."""

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(0).to_pylist()]).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=[*b.schema.names[1:], "score"])

    d = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *carry)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(run, f"{kept}, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
