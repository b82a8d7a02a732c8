"""Toxicity by a linear classifier over character n-grams with naive Bayes scaling.

A text (A-Z lower-cased, runs of space made one, framed by spaces) is the set of its
n-grams of characters (code points), hashed to ``2**BITS`` features. On labelled rows every feature gets the
log ratio of its smoothed frequencies in toxic and other texts; the features with the
most certain ratios are kept, each is worth its ratio where present, and a logistic
regression with L2 penalty weighs them.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, one per doc_id (of several
texts the one with the smallest hash), for the doc_ids with the smallest hashes, never on
held-out ones (crc32(doc_id) mod 4 = 2). That bound also bounds what reaches the driver: per training row the indices of its kept
features. Every document is then scored over its whole text where it lies, with no
shuffle; the model is a few thousand numbers.

Edge cases: null or empty text has no features and scores the intercept; a null
doc_id is not held out; a row labelled more than once is toxic if any label says so;
null labels are none; with no labels at all, or of one kind only, every score is the
share of toxic labels (0 without any); repeated rows are scored one by one; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import materialize

GRAMS, BITS, FEATURES = (3, 4, 5, 6), 18, 4096
MAX_TRAIN, L2, STEPS, THRESHOLD = 20_000, 1.0, 300, 0.3
WINDOW = 1 << 20
_BASE = 2654435769


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def character_values(code: np.ndarray) -> np.ndarray:
    """A well-spread 32-bit number per code point."""
    v = (code.astype(np.uint32) + np.uint32(1)) * np.uint32(_BASE)
    v = (v ^ (v >> np.uint32(16))) * np.uint32(0x45D9F3B5)
    return v ^ (v >> np.uint32(13))


def features(text: str | None, chosen: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text; with ``chosen`` (feature -> place or -1) the places of those chosen."""
    spaced = b" " + b" ".join((text or "").encode("utf-8", "replace").lower().split()) + b" "
    flat = np.frombuffer(spaced.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    found = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(flat), WINDOW):   # long texts in windows that overlap by the longest n-gram
        value = character_values(flat[at:at + WINDOW + GRAMS[-1] - 1])
        h, power = value, 1
        for n in range(2, GRAMS[-1] + 1):
            if len(value) < n:
                break
            power = power * _BASE % 2**32
            h = h[: len(value) - n + 1] + value[n - 1:] * np.uint32(power)
            if n in GRAMS:
                f = ((h ^ (h >> np.uint32(15))) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
                if chosen is not None:
                    f = chosen[f]
                    f = f[f >= 0]
                found.append(np.unique(f))
    return np.unique(np.concatenate(found)).astype(np.int64)


@dataclass
class Model:
    feature: np.ndarray       # kept features
    worth: np.ndarray         # log ratio times weight, per kept feature
    intercept: float

    def chosen(self) -> np.ndarray:
        table = np.full(1 << BITS, -1, dtype=np.int32)
        table[self.feature] = np.arange(len(self.feature))
        return table

    def score(self, text: str | None, table: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.worth[features(text, table)].sum()))))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, toxic, text of the bounded sample."""
    named = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(limit))
    found = (docs.select("doc_id", F.col("text").cast("string"))
             .join(F.broadcast(named), F.col("doc_id") == F.col("label_id")))     # at most ``limit`` ids
    # one text per id, taken map-side: an id that very many rows share is a row per task
    return (found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
            .select("doc_id", "toxic", F.col("t.text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, l2: float = L2, steps: int = STEPS) -> Model:
    rows = materialize(training_rows(docs, labels, limit), "tox-train")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n_toxic, n_other = int(total["t"]), int(total["n"] - total["t"])
    empty = np.zeros(0, dtype=np.int64)
    if not n_toxic or not n_other:
        return Model(empty, np.zeros(0), np.inf if n_toxic else -np.inf)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        for pdf in frames:
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                seen[int(toxic), features(text)] += 1
        f = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"feature": f, "p": seen[1, f], "q": seen[0, f]})

    ratio = F.log((F.col("p") + 1) / (n_toxic + 2.0)) - F.log((F.col("q") + 1) / (n_other + 2.0))
    sure = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    kept = (rows.select("toxic", "text").mapInPandas(count, "feature long, p long, q long")
            .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p + q > 1")
            .withColumn("ratio", ratio).orderBy(sure.desc(), "feature").limit(FEATURES).select("feature", "ratio").toPandas())
    kept = kept.sort_values("feature")
    feature, log_ratio = kept["feature"].to_numpy(np.int64), kept["ratio"].to_numpy()
    table = Model(feature, log_ratio, 0.0).chosen()

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"],
                                "at": [features(t, table).astype("<i4").tobytes() for t in pdf["text"]]})

    got = rows.mapInPandas(places, "doc_id long, toxic int, at binary").toPandas().sort_values(["doc_id", "at"])
    weight, intercept = _logistic([np.frombuffer(x, "<i4") for x in got["at"]], got["toxic"].to_numpy(float), log_ratio, l2, steps)
    return Model(feature, weight * log_ratio, intercept)


def _logistic(rows: list[np.ndarray], y: np.ndarray, value: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression of y on sparse rows whose feature j is worth value[j] (Adam, full batch)."""
    n, k = len(y), len(value)
    col = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    x = value[col]
    w = np.append(np.zeros(k), np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-(np.bincount(row, x * w[col], n) + w[-1]))) - y) / n
        grad = np.append(np.bincount(col, x * error[row], k) + l2 * w[:-1] / n, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.chosen()
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "score": [model.score(t, table) for t in pdf["text"]]})

    read = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return read.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
