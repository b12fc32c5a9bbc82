"""What the vector operators share: clean rows, distances after augmentation, blocks of queries against cells of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """A vector with components, all of them finite numbers."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def taking_part(rows: DataFrame, key: str, vector: str, **more: str) -> DataFrame:
    """row (a number of its own), key, v (array<double>) and ``more`` of the rows that take part: a key, a finite vector, nothing null in ``more``."""
    kept = rows.select(rows[key].alias("key"), F.transform(rows[vector], lambda x: x.cast("double")).alias("v"), *[rows[c].alias(n) for n, c in more.items()])
    kept = kept.where(F.col("key").isNotNull() & finite("v"))
    for name in more:
        kept = kept.where(F.col(name).isNotNull())
    return kept.select(F.monotonically_increasing_id().alias("row"), "*")


def squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)


def facts(rows: DataFrame, chosen: Column) -> Row:
    """dim, the length of most vectors (the greater of equally frequent ones; inner products exist between equal lengths only), and of the vectors of
    that length n, most (greatest squared length) and queries (rows that are ``chosen``); zeros without rows."""
    by = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(squared("v")).alias("most"), F.count(F.when(chosen, 1)).alias("queries"))
    return by.orderBy(F.desc("n"), F.desc("dim")).first() or Row(dim=0, n=0, most=0.0, queries=0)


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: str = "<f8") -> np.ndarray:
    """A column of lists or of binary values, each of ``width`` numbers, as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blobs(values: np.ndarray, kind: str) -> pa.Array:
    """Each row of a matrix as a binary value."""
    values = np.ascontiguousarray(values, kind)
    return pa.array([v.tobytes() for v in values], pa.binary())


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """One more component, which brings every row to the squared length ``most``: among such rows (as queries have 0 there)
    a larger inner product is a smaller Euclidean distance."""
    rest = np.maximum(most - np.einsum("ij,ij->i", x, x), 0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of x and those of y."""
    apart = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(apart, 0))


def farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Places of up to n points, each the farthest from those before it: any first few of them cover the points coarsely."""
    if not len(points):
        return np.zeros(0, int)
    far = distances(points, points.mean(axis=0, keepdims=True))[:, 0]
    chosen = [int(far.argmax())]
    far = distances(points, points[chosen])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most n vectors, those with the least hashes of their keys."""
    found = rows.orderBy(F.xxhash64("key"), "row").limit(n).select("v").toArrow()
    return matrix(found["v"], len(found["v"][0])) if len(found) else np.zeros((0, 0))


def split(df: DataFrame, home: str, most: int, name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` with ``name``: gapless numbers of parts of about ``most`` rows at the most, each of one ``home``; and the first number and
    the count of the parts of each home. A crowded home is dealt out by a hash of the row; ``home`` has few values, from 0."""
    counts = {r["home"]: r["n"] for r in df.groupBy(F.col(home).alias("home")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts, first = [], 0
    for h in range(max(counts, default=-1) + 1):
        n = -(-counts.get(h, 0) // most)
        parts.append((first, n))
        first += n
    if not parts:
        return df.withColumn(name, F.lit(0)), []
    by_home = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(max(n, 1)).alias("n")) for a, n in parts])[F.col(home)]
    return df.withColumn(name, (by_home["first"] + F.pmod(F.xxhash64(F.col("row"), F.lit(name)), by_home["n"])).cast("int")), parts


def best(places: np.ndarray, scores: np.ndarray, ties: np.ndarray, n: int) -> np.ndarray:
    """Of pairs (place, score, tie), the n best of each place: highest scores first, then least ties."""
    order = np.lexsort((ties, -scores, places))
    at = places[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return order[rank < n]


def nth_best(scores: np.ndarray, n: int) -> float:
    return float(np.partition(scores, len(scores) - n)[len(scores) - n]) if len(scores) >= n else -np.inf
