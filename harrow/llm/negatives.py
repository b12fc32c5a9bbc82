"""Hard negatives by a pivot table.

Vectors get one more component, after which inner products are Euclidean
distances. The distances of every row to a few pivots are stored with it. By the triangle
inequality they bracket an anchor's score with a row, and, as ranges, with all rows of a cell, so that cells and
rows out of reach are left out; what survives is checked exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import lookup, materialise, only, table
from .vectors import augmented, best, blobs, distances, facts, farthest, matrix, sample, split, squared, taking_part

PIVOTS = 32
SAMPLE = 4096  # rows among which the pivots are chosen
CELL, BLOCK = 1024, 2048  # rows of a cell, anchors of a block
LARGEST = 2.0**53  # squared lengths up to here make inner products exact in doubles; longer vectors take no part
SLACK = 1e-5  # of a distance, since pivot distances are stored in single precision


def brackets(da: np.ndarray, dx: np.ndarray, n2: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (distances da to the pivots, squared length n2) with each row (distances dx)."""
    near, far = np.zeros((len(da), len(dx))), np.full((len(da), len(dx)), np.inf)
    for a, x in zip(da.T, dx.T, strict=True):
        np.maximum(near, np.abs(a[:, None] - x), out=near)
        np.minimum(far, a[:, None] + x, out=far)
    slack = SLACK * (far + 1)
    near, far = np.maximum(near - slack, 0), far + slack
    middle = (n2 + most)[:, None]
    return (middle - far * far) / 2, (middle - near * near) / 2


class PivotTable:
    """Rows with their pivot distances, dealt into cells, and the anchors among them in blocks.

    ``rows``: key (unique, or repeated rows count each), label and vector; ``code`` turns a component into the whole number that is scored.
    No part: rows with a null key or label, without a finite vector, of another length than most, or longer than ``LARGEST``.
    The driver holds the pivots and one count for each pivot's cells; a task one cell and one block.
    """

    def __init__(self, rows: DataFrame, key: str, label: str, vector: str, every: int, code: Callable[[Column], Column] = lambda x: x, pivots: int = PIVOTS, cell: int = CELL, block: int = BLOCK):
        own = taking_part(rows, key, vector, label=label).withColumn("v", F.transform("v", code))
        own = own.withColumn("n2", squared("v")).where(F.col("n2") < LARGEST)
        is_anchor = F.col("key") % every == 0
        seen = facts(own, is_anchor)
        self.dim, self.most = dim, most = seen.dim, seen.most
        own = own.where(F.size("v") == dim)
        points = augmented(sample(own, SAMPLE), most) if seen.n else np.zeros((1, dim + 1))
        self.pivots = at = points[farthest(points, pivots)]
        coarse = max(1, min(len(at), -(-seen.n // cell))), max(1, min(len(at), -(-seen.queries // block)))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("v"), dim)
                d = distances(augmented(x, most), at)
                # An anchor's own distances: as a query it has 0 as the further component.
                q = distances(np.hstack([x, np.zeros((len(x), 1))]), at)
                homes = [pa.array(d[:, : coarse[0]].argmin(1).astype(np.int32)), pa.array(q[:, : coarse[1]].argmin(1).astype(np.int32))]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(at)), pa.array(m.astype(np.float32).ravel())) for m in (d, q)]
                yield pa.record_batch([b.column("row"), b.column("key"), b.column("label"), b.column("n2"), blobs(x, "<f8"), *lists, *homes], names=["row", "key", "label", "n2", "x", "d", "q", "home", "q_home"])

        kinds = dict(own.dtypes)
        schema = f"row long, key {kinds['key']}, label {kinds['label']}, n2 double, x binary, d array<float>, q array<float>, home int, q_home int"
        rows = materialise(own.select("row", "key", "label", "n2", "v").mapInArrow(measured, schema))
        dealt, _ = split(rows, "home", cell, "cell")
        anchors, parts = split(dealt.where(is_anchor), "q_home", block, "block")
        self.blocks = sum(n for _, n in parts)
        self.rows = dealt.drop("q", "q_home", "home")
        self.anchors = materialise(anchors.drop("d", "home", "q_home"))
        reach = [g(F.col("d")[j]).cast("double") for j in range(len(at)) for g in (F.min, F.max)]
        self.cells = materialise(self.rows.groupBy("cell").agg(F.array(*reach[::2]).alias("low"), F.array(*reach[1::2]).alias("high")))
        self.kinds = kinds

    def scan(self, anchors: DataFrame, on: list[str], rows: DataFrame, take: Callable[[dict, dict, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
        """anchor (row), anchor_id, slot, other (row), other_id, score for what ``take`` chooses from each group of anchors and rows that agree in ``on``."""
        dim, most, width = self.dim, self.most, len(self.pivots)
        key = self.kinds["key"]
        schema = f"anchor long, anchor_id {key}, slot int, other long, other_id {key}, score long"
        empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return empty
            a, x = ({c: t[c].to_pylist() if pa.types.is_list(t[c].type) else t[c].to_numpy() for c in t.column_names if c not in ("x", "d", "q")} for t in (left, right))
            ax, rx = matrix(left["x"], dim), matrix(right["x"], dim)
            low, high = brackets(matrix(left["q"], width, "f4").astype(float), matrix(right["d"], width, "f4").astype(float), a["n2"], most)
            exact = lambda places: ax @ rx[places].T  # noqa: E731  whole numbers below 2^53
            found = take(a, x, low, high, exact)
            i, j, s, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (1, 2, 3, 0))
            return pa.table({"anchor": a["row"][i], "anchor_id": a["key"][i], "slot": n.astype(np.int32), "other": x["row"][j], "other_id": x["key"][j], "score": s.astype(np.int64)})

        keep = [c for c in anchors.columns if c not in ("cell", "block") or c in on]
        return anchors.select(*keep).groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(check, schema)

    def units(self, least: DataFrame, reach: DataFrame) -> DataFrame:
        """(block, cell) pairs within reach: ``least`` holds each block's least wanted score, greatest n2 and ranges of pivot distances."""
        pairs = self.cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(self.blocks - 1, 0)))))
        near = F.greatest(F.lit(0.0), F.array_max(F.zip_with(F.col("low"), F.col("q_high"), lambda c, q: c - q)), F.array_max(F.zip_with(F.col("q_low"), F.col("high"), lambda q, c: q - c)))
        near = F.greatest(F.lit(0.0), near * (1 - SLACK) - SLACK)
        return pairs.join(lookup(least, 24 + 16 * len(self.pivots)), "block").where((F.col("n2") + self.most - near * near) / 2 >= F.col("wanted")).select("block", "cell")

    def best(self, anchors: DataFrame, take: Callable, n: int) -> DataFrame:
        """The n best of each anchor and slot: first from the anchor's own cell, whose n-th score bounds the search, then from all cells within reach.

        ``anchors`` has the column bounds: for each slot the least score wanted.
        """
        own = self.scan(anchors, ["cell"], self.rows, take)
        nth = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"))
        bound = own.withColumn("n", F.row_number().over(nth)).where(F.col("n") == n).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("found"))
        raised = F.transform("bounds", lambda b, i: F.greatest(b, F.coalesce(F.try_element_at("found", i), F.lit(-float("inf")))))
        anchors = materialise(anchors.join(bound.withColumnRenamed("anchor", "row"), "row", "left").withColumn("bounds", raised).drop("found"))
        q = [g(F.col("q")[j]).cast("double") for j in range(len(self.pivots)) for g in (F.min, F.max)]
        least = materialise(anchors.groupBy("block").agg(F.min(F.array_min("bounds")).alias("wanted"), F.max("n2").alias("n2"), F.array(*q[::2]).alias("q_low"), F.array(*q[1::2]).alias("q_high")))
        units = materialise(self.units(least, anchors))
        found = self.scan(anchors.drop("cell").join(lookup(units), "block"), ["block", "cell"], self.rows.join(lookup(units), "cell"), take)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id", "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, code: Callable[[Column], Column] = lambda x: x, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key ``every`` divides; positives the best other rows of their label; negatives the best of other labels with a
    score of ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller key. Rows that take no part: see ``PivotTable``. Rows that
    repeat a key, or whole, count each, as anchors and as others. A positive without negatives gives no row, nor does an empty table.
    """
    held = PivotTable(rows, key, label, vector, every, code, **sizes)

    def same_label(a: dict, x: dict, _: np.ndarray, upper: np.ndarray, exact: Callable) -> list:
        wanted = np.array([b[0] for b in a["bounds"]])
        able = (a["label"][:, None] == x["label"]) & (a["row"][:, None] != x["row"]) & (upper >= wanted[:, None])
        places = np.flatnonzero(able.any(0))
        scores = exact(places)
        i, j = np.nonzero(able[:, places] & (scores >= wanted[:, None]))
        s = scores[i, j]
        top = best(i, s, x["key"][places[j]], positives)
        return [(np.zeros(len(top), int), i[top], places[j[top]], s[top])]

    def in_window(a: dict, x: dict, lower: np.ndarray, upper: np.ndarray, exact: Callable) -> list:
        wide = max((len(b) for b in a["bounds"]), default=0)
        wanted = np.array([[*b, *[np.inf] * (wide - len(b))] for b in a["bounds"]])
        most = np.array([[*b, *[-np.inf] * (wide - len(b))] for b in a["most"]])
        able = (a["label"][:, None] != x["label"]) & (upper >= wanted.min(1)[:, None]) & (lower <= most.max(1)[:, None])
        places = np.flatnonzero(able.any(0))
        scores, able, out = exact(places), able[:, places], []
        for slot in range(wide):
            i, j = np.nonzero(able & (scores >= wanted[:, slot, None]) & (scores <= most[:, slot, None]))
            s = scores[i, j]
            top = best(i, s, x["key"][places[j]], negatives)
            out.append((np.full(len(top), slot), i[top], places[j[top]], s[top]))
        return out

    anchors = held.anchors
    found = held.best(anchors.withColumn("bounds", F.array(F.lit(-float("inf")))), same_label, positives)
    pairs = materialise(found.select("anchor", "anchor_id", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A window of scores is empty where the positive's is negative.
    windows = pairs.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("s")))).alias("p"))
    lowest = F.expr(f"transform(p, x -> if(x.s >= 0, cast((x.s * {low} + 99) div 100 as double), double('inf')))")
    highest = F.expr(f"transform(p, x -> if(x.s >= 0, cast((x.s * {high}) div 100 as double), double('-inf')))")
    with_windows = anchors.join(windows, "row").withColumn("bounds", lowest).withColumn("most", highest).drop("p")
    chosen = held.best(with_windows, in_window, negatives)
    pairs = pairs.withColumn("slot", (F.col("place") - 1).cast("int")).drop("anchor_id")
    out = chosen.join(pairs, ["anchor", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
with t as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, a.label as own, o.vec_id as other_id, o.label as other, list_inner_product(a.v, o.v)::bigint as score
    from t a join t o on a.vec_id <> o.vec_id where a.vec_id % 100 = 0
), p as (
    select anchor_id, other_id as positive_id, score as positive_score from s where own = other
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), n as (
    select p.*, s.other_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id)::integer as rank
    from p join s on p.anchor_id = s.anchor_id where own <> other and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = only(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), code=lambda x: F.floor(256 * x).cast("double"))
