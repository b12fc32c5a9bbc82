"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``positions`` minima of ``_BITS`` bits each; the distance of two
signatures is the number of positions that differ. The positions are split
into ``chunks``: of signatures at distance d <= ``radius``, some chunk differs in at
most radius // chunks positions (pigeonhole). So each chunk is indexed once
for every choice of that many positions to leave out, and all pairs within the
radius meet under an equal key. Links are then confirmed on the full sets; before
that, pairs are dropped whose parity sketches (of each of _LANES * 64 groups of
shingles, whether the set holds an odd number) differ in more places than the sets may.

At similarity s a position differs with probability 1 - s; the radius is the
least that a pair at the wanted similarity exceeds with a probability under ``MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lookup, materialise, only, table, tidy, unused
from .words import hashes

_BITS = 16
_LISTED = 32
MISS = 1e-5
_LANES = 16
FEW = 16  # of a bucket's nodes outside its largest part: so many are compared with all of the bucket, more are told apart by their shingles
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROTATE = np.uint64(29)


def _fold(columns: Iterator[np.ndarray], size: int, seed: int) -> np.ndarray:
    h = np.full(size, (seed + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in columns:
        h = (h ^ c) * _MIX
        h ^= h >> _ROTATE
    return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles, sorted; of fewer words, one for the whole sequence."""
    if not len(words):
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    return np.unique(_fold((words[j : j + n] for j in range(w)), n, w))


class Signer:
    def __init__(self, positions: int):
        self.factors = (np.random.default_rng(7).integers(0, 2**32, positions, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        low = (grams >> np.uint64(17)).astype(np.uint32)
        for i in range(0, len(low), 4096):
            np.minimum(least, (low[i : i + 4096] * self.factors).min(axis=1), out=least)
        return np.pad(least.astype("<u2"), (0, -len(least) % 4)).view(np.int64)


def parities(grams: np.ndarray) -> list[int]:
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % (_LANES * 64), minlength=_LANES * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def chunk_masks(positions: int, chunks: int, radius: int) -> list[tuple[range, list[list[int]]]]:
    """For each chunk its positions, and the positions that each of its keys is made of."""
    edges = [positions * i // chunks for i in range(chunks + 1)]
    return [(range(a, b), [list(x) for x in combinations(range(a, b), max(1, b - a - radius // chunks))]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(positions: int, chunks: int, radius: int) -> list[list[int]]:
    """The positions that each key is made of."""
    return [m for _, own in chunk_masks(positions, chunks, radius) for m in own]


def radius_for(percent: int, positions: int, miss: float = MISS) -> int:
    p, tail, d = 1 - percent / 100, 1.0, -1
    while tail > miss:
        d += 1
        tail -= comb(positions, d) * p**d * (1 - p) ** (positions - d)
    return d


def _batches(column: pa.Array, weight: int = 4 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        size += n
        if size > weight:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column) - start


class NearDuplicates:
    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80, positions: int = 64, radius: int | None = None, chunks: int | None = None, text: str = "text", key: str = "doc_id"):
        self.whole, self.names, self.width, self.percent = docs, (key, text), width, percent
        self.docs = only(docs, key, text).toDF("doc_id", "text")
        self.radius = radius_for(percent, positions) if radius is None else radius
        self.positions, self.chunks = positions, chunk_masks(positions, chunks or self.radius // 2 + 1, self.radius)
        self.masks = [m for _, own in self.chunks for m in own]
        self.bits = max(1, (len(self.masks) - 1).bit_length())  # the last bits of a key are the number of its mask

    def signatures(self) -> DataFrame:
        """doc_id, n_shingles, row (hash of the row), same (digest of the set, null for an empty set), sig, parity."""
        width, positions = self.width, self.positions

        @tidy
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signer = Signer(positions)
            for batch in batches:
                for start, n in _batches(batch.column(2), 1 << 20):
                    part = batch.slice(start, n)
                    sizes, same, sigs, odd = [], [], [], []
                    for words in hashes(part.column(2).to_pylist()):
                        grams = shingles(words, width)
                        sizes.append(len(grams))
                        same.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                        sigs.append(signer(grams) if len(grams) else None)  # four minima in a number
                        odd.append(parities(grams))
                    yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), part.column(1), pa.array(same, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "row", "same", "sig", "parity"])

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.select("doc_id", self._row(), "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, row long, same binary, sig array<long>, parity array<long>")

    @staticmethod
    def _row():
        return F.xxhash64("doc_id", "text").alias("row")

    def _keys(self, reps: DataFrame) -> DataFrame:
        chosen, positions, bits = self.masks, self.positions, np.uint64(self.bits)

        @tidy
        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                node = batch.column(0).to_numpy()
                sig = batch.column(1).flatten().to_numpy().view("<u2").reshape(len(node), -1)[:, :positions].astype(np.uint64)
                for start in range(0, len(node), 2000):
                    part = sig[start : start + 2000]
                    keys = [(_fold((part[:, p] for p in kept), len(part), 100 + i) << bits | np.uint64(i)).view(np.int64) for i, kept in enumerate(chosen)]
                    yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(node[start : start + 2000], len(keys)))], names=["key", "node"])

        return reps.select("node", "sig").mapInArrow(index, "key long, node long")

    def _first_chunk(self, a: str, b: str) -> Column:
        """The number of the first chunk in which two signatures share a key."""
        equal = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(-(-self.positions // 4))]
        differs = lambda p: (F.shiftright(equal[p // 4], 16 * (p % 4)).bitwiseAND(0xFFFF) != 0).cast("int")
        first = F.lit(None).cast("int")
        for k, (own, keys) in reversed(list(enumerate(self.chunks))):
            first = F.when(sum(map(differs, own), F.lit(0)) <= len(own) - len(keys[0]), k).otherwise(first)
        return first

    def _sets(self, nodes: DataFrame, reps: DataFrame) -> DataFrame:
        """node, grams (the full set) of the nodes. Only their texts are read into sets."""
        width = self.width
        wanted = materialise(reps.join(nodes, "node", "left_semi").select("node", "row", "same"))

        @tidy
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, n in _batches(batch.column(0), 1 << 20):
                    grams = [shingles(words, width) for words in hashes(batch.column(0).slice(start, n).to_pylist())]
                    same = [xxhash.xxh3_128_digest(g.tobytes()) for g in grams]
                    yield pa.record_batch([pa.array(same, pa.binary()), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))], names=["same", "grams"])

        rows = self.docs.select(self._row(), "text").join(lookup(wanted.select("row")), "row", "left_semi").select("text")
        return materialise(rows.mapInArrow(sets, "same binary, grams array<long>").join(lookup(wanted.select("node", "same")), "same").select("node", "grams"))

    def _confirm(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        found = self._sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), reps)
        left, right = found.withColumnsRenamed({"node": "a", "grams": "x"}), found.withColumnsRenamed({"node": "b", "grams": "y"})
        shared = F.size(F.array_intersect("x", "y"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        return materialise(both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * self.percent).select("a", "b").distinct())

    def _near(self, n: str, m: str, p: str, q: str) -> Column:
        """Whether sizes n, m and parities p, q allow the wanted similarity."""
        sizes = F.least(n, m) * 100 >= F.greatest(n, m) * self.percent
        differ = sum((F.bit_count(F.get(p, F.lit(i)).bitwiseXOR(F.get(q, F.lit(i)))) for i in range(_LANES)), F.lit(0))
        return sizes & (differ * (100 + self.percent) <= (F.col(n) + F.col(m)) * (100 - self.percent))

    @staticmethod
    def _parts(wide: DataFrame, on: str) -> DataFrame:
        """The values of ``on`` that several parts hold: most (the root of the largest part), others (how many nodes are outside)."""
        sizes = wide.groupBy(on, "root").agg(F.count("*").alias("n")).groupBy(on)
        return sizes.agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("others"), F.count("*").alias("parts")).where("parts > 1").drop("parts")

    def meetings(self, crowd: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes of a crowd (node, root, n) that are in different parts, share a key and meet under a shingle, at least all of these that are similar enough.

        With the shingles of every set in one order, the rarest of the crowd first, the first
        that two sets share stands in each no later than leaves room for as many as they must share.
        So a common frame, which stands last, brings together only sets of little else. A pair comes
        from the first shingle that it shares, as far as the first ``_LISTED`` of both tell.
        """
        grams = self._sets(crowd.select("node"), reps).join(lookup(crowd, 24), "node").select("node", "root", "n", F.explode("grams").alias("gram"))
        common = materialise(grams.groupBy("gram").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram", "c"))
        own = grams.join(lookup(common), "gram").groupBy("node", "root", "n").agg(F.array_sort(F.collect_set(F.struct("c", "gram"))).alias("own"))
        first = own.select("node", "root", "n", F.size("own").alias("k"), F.slice("own.gram", 1, _LISTED).alias("list"), F.posexplode("own").alias("i", "own")).select("node", "root", "n", "list", "own.gram", (F.col("n") - F.col("k") + F.col("i")).alias("at"))
        first = materialise(first.where((F.col("n") - F.col("at")) * 100 >= F.col("n") * self.percent))
        wide = first.join(self._parts(first, "gram").select("gram", "most"), "gram").join(reps.select("node", "parity", "sig"), "node")
        odd = wide.where("root <> most").select("gram", F.col("node").alias("u"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("list").alias("l"), F.col("parity").alias("q"), F.col("sig").alias("s"))
        once = (F.col("root") == F.col("most")) | (F.col("u") < F.col("node"))
        room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by")) * (100 + self.percent) >= (F.col("n") + F.col("m")) * self.percent
        pair = room & self._near("n", "m", "parity", "q") & self._first_chunk("s", "sig").isNotNull()
        new = F.coalesce(F.get(F.array_intersect("l", "list"), F.lit(0)), "gram") == F.col("gram")
        return odd.join(wide, "gram").where((F.col("r") != F.col("root")) & once & pair & new).select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).distinct()

    def links(self, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) between different sets, enough for the right components, and the (node, root) table.

        First every node is tested against the hub of a bucket (the node that
        meets most others over all its buckets) with which it shares most
        buckets; then, in buckets that still hold several
        parts, the nodes outside the largest part are joined with all of another part, under
        the bound of the parity sketches: no bucket has its pairs enumerated within a part, and
        a pair comes only from the first chunk in which it shares a key, not from each of its keys.
        Where more than FEW nodes are outside, those of the bucket meet under their rarest shingles instead.
        """
        keys = self._keys(reps)
        buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        keys = materialise(keys.join(buckets, "key"))
        meets = keys.groupBy("node").agg(F.sum("n").alias("meets"))
        hubs = keys.join(meets, "node").groupBy("key").agg(F.max_by("node", F.struct("meets", (-F.col("node")).alias("h"))).alias("hub"))
        spokes = keys.join(hubs, "key").where("node <> hub").groupBy("hub", "node").agg(F.count("*").alias("n"))
        best = materialise(spokes.groupBy("node").agg(F.max_by("hub", F.struct("n", (-F.col("hub")).alias("h"))).alias("a")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
        links = self._confirm(best, reps)
        parts = components(links)
        wide = materialise(keys.select("key", "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")))
        counts = materialise(self._parts(wide, "key"))
        few = wide.join(counts.where(F.col("others") <= FEW).select("key", "most"), "key").join(reps.select("node", "n", "parity", "sig"), "node")
        odd = few.where("root <> most").select("key", F.col("node").alias("u"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("parity").alias("q"), F.col("sig").alias("s"))
        of_key = F.get(F.array(*[F.lit(k) for k, (_, own) in enumerate(self.chunks) for _ in own]), F.col("key").bitwiseAND((1 << self.bits) - 1).cast("int"))
        once = (F.col("root") == F.col("most")) | (F.col("u") < F.col("node"))  # two nodes outside the largest part meet twice
        cross = odd.join(few, "key").where((F.col("r") != F.col("root")) & once & self._near("n", "m", "parity", "q") & (of_key == self._first_chunk("s", "sig"))).select(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).distinct()
        crowd = materialise(wide.join(counts.where(F.col("others") > FEW).select("key"), "key", "left_semi").select("node", "root").distinct().join(reps.select("node", "n"), "node"))
        if not crowd.isEmpty():
            cross = cross.union(self.meetings(crowd, reps)).distinct()
        more = materialise(cross.join(best, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links = links.union(self._confirm(more, reps))
            parts = components(links)
        return links, parts

    def _assigned(self) -> DataFrame:
        rows = materialise(self.signatures())
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        reps = rows.where("same is not null").groupBy("same").agg(first, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("parity").alias("parity"))
        reps = materialise(reps.withColumns({"row": F.col("first.row"), "node": F.monotonically_increasing_id()}))
        _, parts = self.links(reps)
        of = reps.join(parts, "node", "left").select("same", F.coalesce("root", "node").alias("root"), "first")
        ids = of.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n_texts"))
        of = materialise(of.drop("first").join(ids, "root").select("same", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("stays"), "n_texts"))
        return rows.select("doc_id", "n_shingles", "same", "row").join(of, "same", "left")

    def classes(self) -> DataFrame:
        """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), n_texts (different sets in the component), kept.

        Null or empty texts have no shingle and are linked with nothing; they
        and all others reach themselves. A null doc_id takes part in links but
        is no component_id unless nothing else is reached, and is never kept
        beside another; of rows that repeat both doc_id and text all are kept
        or none. An empty table gives none.
        """
        component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = self._assigned().select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def deduplicated(self) -> DataFrame:
        """The rows of docs, with all their columns, without all but one row of each component; rows without a shingle stay."""
        rows = materialise(self._assigned().select("row", (F.col("same").isNotNull() & (F.col("row") != F.col("stays"))).alias("goes")))
        mark = unused(self.whole, "row_hash")
        out = self.whole.withColumn(mark, F.xxhash64(*self.names))
        gone = materialise(rows.where("goes").select(F.col("row").alias(mark)).distinct())
        out = out.join(lookup(gone), mark, "left_anti")
        twice = materialise(rows.where("not goes").groupBy(F.col("row").alias(mark)).count().where("count > 1").select(mark))
        if not twice.isEmpty():
            twice = lookup(twice)
            out = out.join(twice, mark, "left_anti").unionByName(out.join(twice, mark, "left_semi").dropDuplicates([mark]))
        return out.drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents"), width=3, percent=85).classes().select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
linked as (select a, b from links union all select b, a from links),
reach(doc, node) as (select doc_id, doc_id from documents union select r.doc, l.b from reach r join linked l on r.node = l.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d left join n on d.doc_id = n.doc_id join (select doc, min(node) as component_id from reach group by 1) r on r.doc = d.doc_id"""
