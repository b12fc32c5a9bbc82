"""The longest common prefix of each text with the marks of another table, by an index of prefix hashes.

Texts are cut into chunks. A chain of hashes tells whether the first chunks agree, hashes of
the beginnings of the next chunk how far it does; the index holds each beginning once, with
how many marks have it, so no pairs of texts and marks are made and a common beginning is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_space

CHUNK = 64


def _chained(rows: DataFrame, chunks: Column | int, chunk: int) -> DataFrame:
    """chain: a digest of the first 0, 1, 2, .. whole chunks, of at most ``chunks``."""
    whole = F.least(F.floor(F.length("text") / chunk), F.lit(chunks)).cast("int")
    numbers = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    last = lambda a: F.element_at(a, -1)
    chain = F.aggregate(numbers, F.array(F.lit("")), lambda done, i: F.array_append(done, F.md5(F.concat(last(done), F.substring(F.col("text"), (i - 1) * chunk + 1, F.lit(chunk))))))
    return rows.withColumn("chain", chain)


def _beginnings(rows: DataFrame, j: Column, from_: Column, chunk: int) -> DataFrame:
    """r and digest of the first r characters of chunk j + 1, r from ``from_`` on."""
    rest = F.substring(F.col("text"), j * chunk + 1, F.lit(chunk))
    least = F.greatest(from_, F.lit(1)).cast("int")
    numbers = F.when(F.length(rest) >= least, F.sequence(least, F.length(rest))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("rest", rest).withColumn("r", F.explode(numbers)).withColumn("digest", F.md5(F.substring(F.col("rest"), F.lit(1), F.col("r"))))


def longest_shared(texts: DataFrame, marks: DataFrame, key: str, text: str, mark: str, mark_text: str, by: list[str] | None = None, least: int = 8, share: float = 0.4, chunk: int = CHUNK) -> DataFrame:
    """key, by, shared, marks, mark: for each text how many characters it shares with the marks that begin most like it, how many marks those are and the least of them.

    White space and case don't count. Only texts with a shared beginning of ``least`` characters and ``share`` of their length come out. ``by``
    names columns that must agree, such as the page. Null and blank texts and marks share nothing; texts that repeat a key come out each.
    """
    by = by or []
    t = texts.select(F.col(key).alias("key"), *by, no_space(text).alias("text")).where("text <> ''")
    row = F.md5(F.to_json(F.struct("key", *by, "text")))  # repeated rows are one until the end
    t = t.groupBy(row.alias("row")).agg(*[F.first(c).alias(c) for c in ("key", *by, "text")], F.count(F.lit(1)).alias("times"))
    m = marks.select(F.col(mark).alias("mark"), *by, no_space(mark_text).alias("text")).where("text <> ''")
    longest = marks.agg(F.max(F.length(no_space(mark_text)))).first()[0] or 0
    deepest = longest // chunk
    t = t.withColumn("need", F.greatest(F.lit(least), F.floor(F.length("text") * share)).cast("int"))
    # No text shares more than the longest mark has.
    t = _chained(t.where(F.col("need") <= longest).withColumn("text", F.substring("text", 1, longest)), deepest, chunk)
    m = _chained(m, deepest, chunk)
    held = [F.count(F.lit(1)).alias("marks"), F.min("mark").alias("mark")]
    whole = m.select(*by, "mark", F.posexplode("chain").alias("j", "hash")).groupBy(*by, "j", "hash").agg(*held)
    # How many whole chunks agree: a chain that agrees at j agrees before it too.
    chains = t.select("row", *by, F.posexplode("chain").alias("j", "hash"))
    deep = chains.join(whole, [*by, "j", "hash"]).groupBy("row").agg(F.max_by(F.struct("j", "hash", "marks", "mark"), "j").alias("d"))
    at = t.join(deep, "row").select("row", "key", "times", *by, "text", "need", F.col("d.j").alias("j"), F.col("d.hash").alias("hash"), F.col("d.marks").alias("marks"), F.col("d.mark").alias("mark"))
    within = _beginnings(at.select("row", *by, "text", "need", "j", "hash"), F.col("j"), F.col("need") - F.col("j") * chunk, chunk)
    ends = at.select(*by, "j", "hash").distinct()
    next_ = m.select(*by, "mark", "text", F.posexplode("chain").alias("j", "hash")).join(ends, [*by, "j", "hash"], "left_semi")
    index = _beginnings(next_, F.col("j"), F.lit(1), chunk).groupBy(*by, "j", "hash", "r", "digest").agg(*held)
    more = within.select("row", *by, "j", "hash", "r", "digest").join(index, [*by, "j", "hash", "r", "digest"]).groupBy("row").agg(F.max_by(F.struct("r", "marks", "mark"), "r").alias("e"))
    out = at.join(more, "row", "left").withColumn("shared", (F.col("j") * chunk + F.coalesce(F.col("e.r"), F.lit(0))).cast("int"))
    found = out.where(F.col("shared") >= F.greatest("need", F.lit(1))).withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return found.select(F.col("key").alias(key), *by, "shared", *[F.when(F.col("e").isNull(), F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) for c in ("marks", "mark")])
