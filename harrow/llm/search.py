"""Approximate nearest neighbours by an adaptive dimension scan of the probed lists.

Vectors get one more component, after which inner products are Euclidean distances, and are
rotated at random; so the first d components hold a share of a squared distance that
follows a beta distribution, whatever the data. A query reads each list that it
probes by blocks of columns and, after each block, drops the candidates whose partial distance is
too large for a true distance within the bound it already has. What is left is scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import lookup, materialise, only, table
from .vectors import augmented, best, blobs, distances, facts, farthest, matrix, nth_best, sample, split, squared, taking_part

SAMPLE = 16_384  # rows to which the lists are fitted
LISTS, LIST_ROWS = 1024, 1024  # lists at most; rows of a list as long as there are fewer lists
CELL, BLOCK = 1024, 1024  # rows of a cell (a list or a part of one), queries of a block
COLUMNS = 16  # of a block of columns
LOSS = 0.002  # probability that one test drops a true neighbour
TRIED, RECALL = 64, 0.97  # queries answered by brute force to choose the number of lists, and the share of their neighbours that must lie in them


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shares(dim: int, columns: int = COLUMNS, loss: float = LOSS, seed: int = 7) -> list[tuple[int, float]]:
    """(d, the greatest share of a squared distance that d of ``dim`` rotated components hold but with a probability of ``loss``)."""
    draw, out = np.random.default_rng(seed), []
    for d in range(columns, dim, columns):
        out.append((d, float(np.quantile(draw.beta(d / 2, (dim - d) / 2, 200_000), 1 - loss))))
    return [*out, (dim, 1.0)]


def lists(points: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by k-means on the sample; a list that loses all its points keeps its centroid."""
    at = points[np.random.default_rng(seed).permutation(len(points))[:n]].copy()
    for _ in range(rounds if n > 1 else 1):
        own = distances(points, at).argmin(1)
        sums, counts = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, points)
        at[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return at


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def scan(q: np.ndarray, x: np.ndarray, within: np.ndarray, tests: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no test drops; ``within`` is each query's squared distance bound."""
    i = j = part = None
    start = 0
    for stop, share in tests:
        a, b = q[:, start:stop], x[:, start:stop]
        limit = within * share * (1 + 1e-5) + 1e-6
        if i is None:
            part = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
            i, j = np.nonzero(part <= limit[:, None])
            part = part[i, j]
        else:
            for at in range(0, len(i), 1 << 18):
                own = slice(at, at + (1 << 18))
                step = a[i[own]] - b[j[own]]
                part[own] += np.einsum("ij,ij->i", step, step)
            kept = part <= limit[i]
            i, j, part = i[kept], j[kept], part[kept]
        start = stop
    return i, j


class Index:
    """Every row in one of the lists, each dealt into cells; the queries among the rows in blocks.

    The driver holds the centroids, the counts of the lists and the answers to ``TRIED`` queries; a task holds one cell and one block.
    """

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, list_rows: int = LIST_ROWS, cell: int = CELL, block: int = BLOCK, recall: float = RECALL):
        self.k, self.recall = k, recall
        own = taking_part(rows, key, vector).where(F.exists("v", lambda x: x != 0) & (squared("v") < float("inf")))
        is_query = F.col("key") % every == 0
        seen = facts(own, is_query)
        self.dim, self.most = dim, most = seen.dim, seen.most
        own = own.where(F.size("v") == dim)
        points = augmented(sample(own, SAMPLE), most) if seen.n else np.zeros((1, dim + 1))
        # Scaled to the longest vector, so that single precision is enough.
        self.turn = turn = (rotation(dim + 1) / max(np.sqrt(most), 1e-300)).astype(np.float64)
        n = max(1, min(LISTS, -(-seen.n // list_rows), len(points)))
        self.centroids = at = lists(points, n)
        # Blocks of queries that lie together: by the nearest of a few lists far apart.
        coarse = at[farthest(at, max(1, -(-seen.queries // block)))]

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column("v"), dim)
                x = augmented(v, most)
                home = distances(x, at).argmin(1).astype(np.int32)
                group = distances(np.hstack([v, np.zeros((len(v), 1))]), coarse).argmin(1).astype(np.int32)
                yield pa.record_batch([b.column("row"), b.column("key"), blobs(v, "<f8"), blobs(x @ turn.T, "<f4"), pa.array(home), pa.array(group)], names=["row", "key", "v", "x", "home", "group"])

        self.key = dict(own.dtypes)["key"]
        rows = materialise(own.select("row", "key", "v").mapInArrow(coded, f"row long, key {self.key}, v binary, x binary, home int, group int"))
        self.rows, self.parts = split(rows, "home", cell, "cell")
        self.queries, blocks = split(self.rows.where(is_query), "group", block, "block")
        self.counts = {r["home"]: r["n"] for r in rows.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.blocks = sum(m for _, m in blocks)

    def exact(self, queries: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> DataFrame:
        """query (row), other (row), other_id, home, score of the k nearest of each of a few queries, by brute force."""
        dim, k = self.dim, self.k

        def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, row, key = matrix(b.column("v"), dim), b.column("row").to_numpy(), b.column("key").to_numpy(zero_copy_only=False)
                scores = queries @ v.T
                scores[numbers[:, None] == row] = -np.inf
                nth = [nth_best(s, k) for s in scores]
                i, j = np.nonzero((scores >= np.array(nth)[:, None]) & np.isfinite(scores))
                top = best(i, scores[i, j], key[j], k)
                i, j = i[top], j[top]
                yield pa.record_batch([pa.array(numbers[i]), pa.array(row[j]), b.column("key").take(pa.array(j)), b.column("home").take(pa.array(j)), pa.array(scores[i, j])], names=["query", "other", "other_id", "home", "score"])

        found = self.rows.select("row", "key", "v", "home").mapInArrow(best_of, f"query long, other long, other_id {self.key}, home int, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "other_id", "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def probes(self) -> int:
        """The least number of lists in which the wanted share of the tried queries' true neighbours lies."""
        tried = self.queries.orderBy(F.xxhash64("key"), "row").limit(TRIED).select("row", "key", "v").toArrow()
        if not len(tried) or len(self.centroids) == 1:
            return 1
        q = matrix(tried["v"], self.dim)
        numbers = tried["row"].to_numpy()
        place = distances(np.hstack([q, np.zeros((len(q), 1))]), self.centroids).argsort(1).argsort(1)
        of = {n: i for i, n in enumerate(numbers)}
        found = self.exact(q, tried["key"].to_numpy(), numbers).select("query", "home").collect()  # TRIED * k rows at most
        at = sorted(int(place[of[r["query"]], r["home"]]) for r in found)
        return at[min(len(at) - 1, int(np.ceil(self.recall * len(at))) - 1)] + 1 if at else 1

    def search(self, probes: int | None = None) -> DataFrame:
        """query (row), query_id, rank, other (row), other_id, score."""
        probes = self.probes() if probes is None else probes
        dim, turn, at, k, key, most = self.dim, self.turn, self.centroids, self.k, self.key, self.most
        sizes = np.array([self.counts.get(h, 0) for h in range(len(at))])
        tests = shares(dim + 1)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The nearest lists of each query, as many more as hold k other rows, and its own."""
            for b in batches:
                order = distances(np.hstack([matrix(b.column("v"), dim), np.zeros((b.num_rows, 1))]), at).argsort(1)
                wide = np.maximum(probes, (np.cumsum(sizes[order], 1) <= k).sum(1) + 1)
                lists_of = [np.union1d(o[:w], [h]).astype(np.int32) for o, w, h in zip(order, wide, b.column("home").to_pylist(), strict=True)]
                yield pa.record_batch([*b.columns, pa.array(lists_of, pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

        named = self.queries.select("row", "key", "v", "home", "cell", "block")
        queries = materialise(named.mapInArrow(probed, f"row long, key {key}, v binary, home int, cell int, block int, lists array<int>"))
        schema = f"query long, query_id {key}, other long, other_id {key}, score double"
        none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

        def found(q: dict, x: dict, i: np.ndarray, j: np.ndarray, wanted: np.ndarray) -> pa.Table:
            apart = q["row"][i] != x["row"][j]
            i, j = i[apart], j[apart]
            s = np.concatenate([inner(q["v"][i[n : n + 65536]], x["v"][j[n : n + 65536]]) for n in range(0, len(i), 65536)] or [np.zeros(0)])
            near = s >= wanted[i]
            i, j, s = i[near], j[near], s[near]
            top = best(i, s, x["key"][j], k)
            i, j = i[top], j[top]
            return pa.table({"query": q["row"][i], "query_id": q["key"][i], "other": x["row"][j], "other_id": x["key"][j], "score": s[top]})

        def numbers(t: pa.Table) -> dict:
            return {"row": t["row"].to_numpy(), "key": t["key"].to_numpy(), "v": matrix(t["v"], dim)}

        def own_cell(left: pa.Table, right: pa.Table) -> pa.Table:
            """Exact, so that each query has a bound."""
            if not len(left) or not len(right):
                return none
            q, x = numbers(left), numbers(right)
            scores = q["v"] @ x["v"].T
            scores[q["row"][:, None] == x["row"]] = -np.inf
            nth = np.array([nth_best(s, k) for s in scores])
            slack = 1e-9 * (1 + np.abs(nth))
            i, j = np.nonzero(scores >= np.where(np.isfinite(nth), nth - slack, -np.inf)[:, None])
            return found(q, x, i, j, np.full(len(nth), -np.inf))

        def other_cells(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return none
            home = right["home"][0].as_py()
            left = left.filter(pa.array([home in x for x in left["lists"].to_pylist()]))
            if not len(left):
                return none
            q, x = numbers(left), numbers(right)
            turned = np.hstack([q["v"], np.zeros((len(left), 1))]) @ turn.T
            wanted = left["bound"].to_numpy()
            within = np.maximum(np.einsum("ij,ij->i", q["v"], q["v"]) + most - 2 * wanted, 0) / most
            i, j = scan(turned.astype(np.float32), matrix(right["x"], dim + 1, "<f4"), within, tests)
            return found(q, x, i, j, wanted)

        # The own cell first: its k-th score bounds the scan of the others.
        own = queries.select("cell", "row", "key", "v").groupBy("cell").cogroup(self.rows.select("cell", "row", "key", "v").groupBy("cell"))
        first = materialise(own.applyInArrow(own_cell, schema))
        bound = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
        bounded = queries.join(bound, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(-float("inf"))))
        wanted = bounded.select("block", F.explode("lists").alias("home")).distinct()
        units = materialise(wanted.join(lookup(self.cells()), "home").select("block", "cell"))
        dealt = bounded.drop("home", "cell").join(lookup(units), "block").groupBy("block", "cell")
        rest = dealt.cogroup(self.rows.select("row", "key", "v", "x", "home", "cell").join(lookup(units), "cell").groupBy("block", "cell")).applyInArrow(other_cells, schema)
        # A row of the own cell comes twice.
        once = first.union(rest).groupBy("query", "query_id", "other", "other_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "other_id", "other")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def cells(self) -> DataFrame:
        """home, cell: the parts of each list."""
        spark = self.rows.sparkSession
        firsts = spark.createDataFrame([(h, first, n) for h, (first, n) in enumerate(self.parts)], "home int, first int, n int")
        return firsts.where("n > 0").select("home", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("cell"))


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, **sizes: float) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key ``every`` divides the k other rows found with the largest inner products.

    Nearest first, ties to the smaller key; all others where there are fewer than k. Every row is indexed; only the lists are fitted to
    a sample of ``SAMPLE`` rows. The number of probed lists is the least that holds ``RECALL`` of the true neighbours
    of ``TRIED`` queries, found by brute force. No part: rows with a null key, a null or zero vector, or one that holds null or non-finite
    components, has another length than most or no finite squared length. Rows that repeat a key, or whole, count each, as queries and as others; an empty table gives no row.
    """
    found = Index(rows, key, vector, every, k, **sizes).search()
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
