"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades: 0 for a row labelled clean; a row labelled toxic is 1, or 2 if the share
of marker words (words far commoner in toxic rows) among its words is at least
the median of the toxic rows. P(grade > k) = sigmoid(w x - t_k): the weights w
are shared by the ordered thresholds t.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, shared, table
from .learning import SAMPLE_ROWS, Ftrl, bucket_sums, mix, sample

BUCKETS_LOG2, GRADES = 17, 3
MARKER_ODDS = 1.5  # log odds from which a word marks toxic rows
_WORD = re.compile(r"[^\W\d_]+")


class Words(dict):
    """The feature buckets of a word: the word itself and its beginnings of 4 to 6 letters. Forgets when it grows too large."""

    limit = 300_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]
        self[word] = at = tuple(xxhash.xxh32_intdigest(p) >> 32 - BUCKETS_LOG2 for p in parts)
        return at

    def features(self, text: str | None) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        found = set()
        for word in set(_WORD.findall((text or "").lower())):
            found.update(self[word])
        return np.fromiter(found, np.int64, len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SeverityModel:
    def __init__(self, alpha: float = 0.5, l1: float = 4.0, l2: float = 0.01):
        self.ftrl = Ftrl((1 << BUCKETS_LOG2,), alpha, l1, l2)
        self.thresholds = np.array([1.0 + k for k in range(GRADES - 1)])
        self.squares = np.ones(GRADES - 1)
        self.dense: np.ndarray | None = None
        self.words: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"words": None}

    def weights_only(self) -> SeverityModel:
        """What predictions need, without the state of the training."""
        out = copy.copy(self)
        out.ftrl = None
        return out

    @property
    def arrays(self) -> list[np.ndarray]:
        return [*self.ftrl.arrays, self.thresholds, self.squares]

    def features(self, text: str | None) -> np.ndarray:
        if self.words is None:
            self.words = Words()
        return self.words.features(text)

    def learn(self, rows: Iterator[tuple[str, int]]) -> int:
        seen = 0
        for text, grade in rows:
            at = self.features(text)
            w = self.ftrl.weights(at)
            s = float(w.sum())
            upper = _sigmoid(self.thresholds[grade] - s) if grade < GRADES - 1 else 1.0
            lower = _sigmoid(self.thresholds[grade - 1] - s) if grade else 0.0
            self.ftrl.update(at, w, np.full(len(at), 1 - upper - lower, np.float32))
            p = max(upper - lower, 1e-6)
            g = np.zeros(GRADES - 1)
            if grade < GRADES - 1:
                g[grade] -= upper * (1 - upper) / p
            if grade:
                g[grade - 1] += lower * (1 - lower) / p
            g = np.clip(g, -5, 5)
            self.squares += g * g
            self.thresholds -= 0.5 * g / np.sqrt(self.squares)
            np.maximum.accumulate(self.thresholds, out=self.thresholds)
            seen += 1
        return seen

    def exceeds(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold, falling in k; zeros for a text without words."""
        at = self.features(text)
        return _sigmoid(self.dense[at].sum() - self.thresholds) if len(at) else np.zeros(GRADES - 1)


def _markers(rows: DataFrame) -> np.ndarray:
    """Which buckets mark toxic rows, by smoothed log odds over the rows of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros((2, (1 << BUCKETS_LOG2) + 1), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[y, np.append(words.features(t), -1)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.record_batch([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["k", "clean", "toxic"])

    got = bucket_sums(rows.select("body", "toxic").mapInArrow(count, "k long, clean long, toxic long"), "k", "clean", "toxic")
    sums = np.zeros((2, (1 << BUCKETS_LOG2) + 1))
    sums[0, got["k"]], sums[1, got["k"]] = got["clean"], got["toxic"]
    rate = (sums[:, :-1] + 0.5) / (sums[:, -1:] + 1)
    return (np.log(rate[1] / rate[0]) > MARKER_ODDS) & (sums[1, :-1] >= 5)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS, rounds: int = 5) -> SeverityModel | None:
    """Learn from about ``sample_rows`` labelled documents at most.

    A doc_id with several labels counts as toxic if one says so; null labels and
    null doc_ids are left out. None where one of the two kinds is missing.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(F.col(toxic).cast("int")) > 0).cast("int").alias("toxic"))
    marks = materialise(sample(marks.withColumn("all", F.lit(1)), "all", F.col("key"), sample_rows).drop("all"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).join(lookup(marks), "key")
    rows = materialise(rows)
    if rows.select("toxic").distinct().count() < 2:
        return None
    get = shared(spark, _markers(rows))

    def density(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, marks = Words(), get()
        for body in bodies:
            found = [(sum(bool(marks[words[w][0]]) for w in of), len(of)) for of in (_WORD.findall((t or "").lower()) for t in body)]
            yield pd.Series([a / n if n else 0.0 for a, n in found])

    graded = materialise(rows.withColumn("share", F.when(F.col("toxic") == 1, F.pandas_udf(density, "double")("body"))))
    median = graded.agg(F.percentile_approx("share", 0.5).alias("m")).first().m
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("share") < median, 1).otherwise(2)
    model = mix(graded.select(F.xxhash64("key", "body").alias("key"), "body", grade.cast("int").alias("grade")), SeverityModel(), SeverityModel.learn, rounds)
    model.dense = model.ftrl.weights()
    return model


def severity(docs: DataFrame, model: SeverityModel | None, text: str = "text", into: str = "severity") -> DataFrame:
    """docs with a struct ``into`` (in place of an input column of that name): expected (grade), grade (the median of the predicted grades), toxic (P(grade > 0) >= 0.5).

    Null and empty texts, and all texts where there is no model, are 0, 0, false.
    Texts are read whole; repeated rows get the same; an empty table gives none.
    """
    kind = "expected double, grade int, toxic boolean"
    if model is None:
        return docs.withColumn(into, F.struct(F.lit(0.0).alias("expected"), F.lit(0).alias("grade"), F.lit(False).alias("toxic")))
    get = shared(docs.sparkSession, model.weights_only())

    def judge(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = get()
        for body in bodies:
            p = np.array([own.exceeds(t) for t in body]).reshape(-1, GRADES - 1)
            yield pd.DataFrame({"expected": p.sum(axis=1), "grade": (p >= 0.5).sum(axis=1), "toxic": p[:, 0] >= 0.5})

    return docs.withColumn(into, F.pandas_udf(judge, kind)(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.col("severity.expected").alias("expected_severity"), F.col("severity.grade").alias("grade"), F.col("severity.toxic").alias("toxic"))
