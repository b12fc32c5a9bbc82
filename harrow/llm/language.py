"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic net, then temperature-calibrated."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, packed, shared, table, tidy
from .learning import SAMPLE_ROWS, Ftrl, bucket_sums, mix, sample

BUCKETS_LOG2 = 15
TEMPERATURES = np.geomspace(0.02, 5, 56)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of the lower-cased code points, and their counts."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    h1 = c * np.uint32(0x9E3779B1)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h1[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + h1[2:]
    mixed = np.concatenate([h1, h2, h3])
    mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    counts = np.bincount(mixed >> np.uint32(32 - BUCKETS_LOG2), minlength=1 << BUCKETS_LOG2)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    def __init__(self, labels: list[str], idf: np.ndarray, alpha: float = 0.5, l1: float = 0.1, l2: float = 1e-4):
        self.labels, self.idf, self.temperature = labels, idf.astype(np.float32), 1.0
        self.ftrl = Ftrl((len(idf) + 1, len(labels)), alpha, l1, l2)  # the last row: the intercepts
        self.dense: np.ndarray | None = None

    def weights_only(self) -> LanguageModel:
        """What predictions need, without the state of the training."""
        out = copy.copy(self)
        out.ftrl = None
        return out

    @property
    def arrays(self) -> list[np.ndarray]:
        return self.ftrl.arrays

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = grams(text)
        x = (1 + np.log(counts)).astype(np.float32) * self.idf[at]
        return np.append(at, len(self.idf)), np.append(x / np.sqrt(x @ x), np.float32(1))

    def learn(self, rows: Iterator[tuple[str, int]]) -> int:
        seen = 0
        for text, label in rows:
            at, x = self.features(text)
            w = self.ftrl.weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            self.ftrl.update(at, w, x[:, None] * p[None, :].astype(np.float32))
            seen += 1
        return seen

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return x @ self.dense[at]

    def predict(self, text: str) -> tuple[str, float]:
        s = self.logits(text) / self.temperature
        p = np.exp(s - s.max())
        k = int(p.argmax())
        return self.labels[k], float(p[k] / p.sum())


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _idf(rows: DataFrame) -> np.ndarray:
    """From the document frequencies over all rows."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKETS_LOG2, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[grams(t.as_py())[0]] += 1
                n += 1
        at = np.append(np.flatnonzero(df), len(df))
        yield pa.record_batch([pa.array(at), pa.array(np.append(df[at[:-1]], n))], names=["k", "n"])

    got = bucket_sums(rows.select("body").mapInArrow(count, "k long, n long"), "k", "n")
    df = np.zeros((1 << BUCKETS_LOG2) + 1)
    df[got["k"]] = got["n"]
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, rounds: int = 4) -> LanguageModel | None:
    """Learn from the labelled rows that are not held out. Document frequencies are those of all of these rows; the
    weights are fitted on about ``sample_rows`` of them at most, a fifth of which sets the temperature. None without labels."""
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & has_letter(text)).select(F.col(text).alias("body"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key, text).alias("key"))
    chosen = materialise(sample(rows, "lang", F.col("key"), sample_rows).withColumn("turn", F.pmod(F.xxhash64("key", F.lit("turn")), F.lit(5))))
    labels = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not labels:
        return None
    number = F.lit(0)
    for i, v in enumerate(labels):
        number = F.when(F.col("lang") == v, F.lit(i)).otherwise(number)
    chosen = chosen.select("body", number.alias("label"), "turn", "key")
    model = LanguageModel(labels, _idf(rows))
    mix(chosen.where("turn <> 0").select("key", "body", "label"), model, LanguageModel.learn, rounds)
    model.dense = model.ftrl.weights()
    get = shared(docs.sparkSession, model)

    @tidy
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = get(), np.zeros(len(TEMPERATURES))
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = own.logits(t)[None, :] / TEMPERATURES[:, None]
                s = s - s.max(axis=1, keepdims=True)
                total += np.log(np.exp(s).sum(axis=1)) - s[:, y]
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["t", "loss"])

    sums = chosen.where("turn = 0").select("body", "label").mapInArrow(losses, "t long, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
    model.temperature = float(TEMPERATURES[min(sums, key=lambda r: (r.loss, r.t)).t]) if sums and any(r.loss for r in sums) else 1.0
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its calibrated probability (in place of input columns of these names).

    ``und`` at score 0 for null texts, texts without a letter and without a model. The
    prediction sees the text only; repeated rows get the same; an empty table gives none.
    """
    if model is None:
        return docs.withColumns({lang_pred: F.lit("und"), score: F.lit(0.0)})
    get = shared(docs.sparkSession, model.weights_only())

    @tidy
    def guess(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = get()
        for body in bodies:
            yield pd.DataFrame([own.predict(t or "") for t in body], columns=["lang", "score"])

    found = F.pandas_udf(guess, "lang string, score double")
    marked = packed(docs, body=text).withColumn("guess", found("body"))
    known = has_letter("body")
    kept = [F.col(f"kept.`{c}`").alias(c) for c in docs.columns if c not in (lang_pred, score)]
    return marked.select(*kept, F.when(known, F.col("guess.lang")).otherwise("und").alias(lang_pred), F.when(known, F.col("guess.score")).otherwise(0.0).alias(score))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
