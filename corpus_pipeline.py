"""A training corpus in five stages: language ID, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import decontaminate, language, linededup, neardup, packing
from harrow.llm.common import shared_folder, small_batches, table, unused

LEAST_SCORE = 0.5  # of the predicted language; documents below it, or without a letter, are rejected

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some confidence; all of them where no label is there to learn from."""
    small_batches(spark)
    model = language.fit(docs)
    if model is None:
        return docs
    named = dict(zip(("lang_pred", "score"), (unused(docs, c) for c in ("lang_pred", "score")), strict=True))
    marked = language.identify(docs, model, **named)
    return marked.where((F.col(named["lang_pred"]) != "und") & (F.col(named["score"]) >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; those of which nothing but white space is left go."""
    cleaned = linededup.line_dedup(docs)
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col("body").rlike(r"\S"))
    new = {"text": F.col("body"), "n_chars": F.when(F.col("n_removed") > 0, F.length("body")).otherwise(F.col("kept.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cleaned.select(*[new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return neardup.NearDuplicates(docs).deduplicated()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of a benchmark item."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, keep_ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
