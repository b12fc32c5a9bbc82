"""What the two text classifiers share: a bounded sample, the FTRL-proximal step, and training in parallel parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, shared

SAMPLE_ROWS = 20_000  # labelled rows that a classifier is fitted on, at most (expected number)
PARTS, PART_ROWS = 6, 3000  # groups that learn side by side: as many as have PART_ROWS rows each, PARTS at most


def sample(rows: DataFrame, by: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows at most, as many for each value of ``by`` as there are, chosen by a hash of ``key``."""
    counts = [(r[0], r[1]) for r in rows.groupBy(by).count().collect()]
    rate = F.lit(0.0)
    for value, n in counts:
        rate = F.when(F.col(by) == value, F.lit(min(1.0, most / len(counts) / n))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < rate * (1 << 20))


class Ftrl:
    """Follow the regularised leader with elastic-net penalties; a row of z and n for each feature."""

    def __init__(self, shape: tuple[int, ...], alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(shape, np.float32), np.zeros(shape, np.float32)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / step).astype(np.float32)

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.z, self.n]


def mix(rows: DataFrame, model, learn: Callable[[object, Iterator[tuple]], int], rounds: int):
    """``rounds`` times: up to PARTS groups of rows learn on their own from the same state; the states are averaged by their rows.

    rows: key, and what ``learn`` takes. ``model.arrays`` is the state; the driver
    sees that of each group and no row. A group holds its share of a bounded
    sample, whatever the number of partitions.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "key"]
    groups = max(1, min(PARTS, rows.count() // PART_ROWS))
    model.ftrl.l1 /= groups  # z grows with the rows of a group, and the penalty with it
    grouped = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(groups)))
    schema = "seen long, " + ", ".join(f"a{i} binary" for i in range(len(model.arrays)))
    for _ in range(rounds):
        get = shared(spark, model)

        def part(table):  # Arrow table to Arrow table; hints would be read as the kind of function
            own = get()  # noqa: B023
            table = table.sort_by("key").select(names)
            seen = learn(own, (r for b in table.to_batches(500) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
            out = pa.table([pa.array([seen], pa.int64())] + [pa.array([a.tobytes()], pa.binary()) for a in own.arrays], names=["seen", *(f"a{i}" for i in range(len(own.arrays)))])
            del own, table
            give_back()
            return out

        got = [r for r in grouped.groupBy("part").applyInArrow(part, schema).collect() if r.seen]  # PARTS states at most
        total = sum(r.seen for r in got)
        for i, a in enumerate(model.arrays):
            if total:
                a[...] = sum(np.frombuffer(r[f"a{i}"], a.dtype).reshape(a.shape) * (r.seen / total) for r in got)
        get.drop()
    return model


def bucket_sums(counts: DataFrame, key: str, *values: str) -> dict[str, np.ndarray]:
    """Sums of counts by bucket: a row a bucket comes to the driver, as columns."""
    table = counts.groupBy(key).agg(*[F.sum(v).alias(v) for v in values]).toArrow()
    return {c: table.column(c).to_numpy() for c in (key, *values)}
