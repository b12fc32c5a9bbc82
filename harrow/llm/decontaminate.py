"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``width`` words. A document contains a window
only if it contains every shingle of it, so for containment of 1.0 the prefix
of a window, its shingles in order of rarity, is one shingle long: the rarest.
Occurrences of these prefix shingles are joined with the windows, bounded by
position and length, and verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PASSAGES, lookup, materialise, merged, only, shared, table, tidy

BLOCK_BYTES = 8 << 20  # of benchmark text whose windows are broadcast at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Words are digits, letters A-Z (lower-cased) and all beyond ASCII; the rest separates.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def _codes(ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which s known words follow each other, and a code of these words."""
    n = len(ids) - s + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids >= 0
    ok = known[:n].copy()
    for j in range(1, s):
        ok &= known[j : j + n]
    at = np.flatnonzero(ok)
    code = np.zeros(len(at), np.uint64)
    for j in range(s):
        code = (code ^ (ids[at + j].astype(np.uint64) + np.uint64(1))) * _MIX
        code ^= code >> np.uint64(29)
    return at, code


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (n[0] of them), then those of first[1] and so on."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Windows:
    """The different windows of one block of items as rows of word numbers, and after ``choose`` the prefix shingle of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        texts = [words_of(t) for _, t in items]
        flat = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in chain.from_iterable(texts)], np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        length, starts = np.minimum(sizes, width), np.cumsum(sizes) - sizes
        count = np.where(sizes > 0, sizes - length + 1, 0)
        at, length = _ranges(starts, count), np.repeat(length, count)
        rows = np.full((len(at), width), -2, np.int32)
        for j in range(width):
            inside = j < length
            rows[inside, j] = flat[at[inside] + j]
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rank = np.array([number[i] for i, _ in items], np.int64)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.length = (self.rows >= 0).sum(axis=1)
        # the items of each window, one after the other in order of name
        pairs = np.unique(np.stack([which.reshape(-1), rank[np.repeat(np.arange(len(items)), count)]], axis=1), axis=0)
        self.item, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.shingle_of = np.minimum(shingle, self.length)
        self.lengths = sorted(set(self.shingle_of.tolist()))
        self.shingles = {s: np.unique(self._row_codes(s)[1]) for s in self.lengths}

    def _row_codes(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of prefix length s, the codes of their shingles and which of these are inside the window."""
        own = np.flatnonzero(self.shingle_of == s)
        n = self.rows.shape[1] - s + 1
        codes = np.zeros((len(own), n), np.uint64)
        for j in range(s):
            codes = (codes ^ (self.rows[own, j : j + n].astype(np.uint64) + np.uint64(1))) * _MIX
            codes ^= codes >> np.uint64(29)
        inside = np.arange(n)[None, :] + s <= self.length[own, None]
        return own, np.where(inside, codes, codes[:, :1]), inside

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """counts: for each shingle length the occurrences of its shingles in the corpus."""
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}
        for s in self.lengths:
            own, codes, inside = self._row_codes(s)
            often = np.where(inside, counts[s][np.searchsorted(self.shingles[s], codes)], np.iinfo(np.int64).max)
            offset = np.where(often == often.min(axis=1, keepdims=True), codes, np.iinfo(np.uint64).max).argmin(axis=1)
            chosen = codes[np.arange(len(own)), offset]
            order = np.argsort(chosen, kind="stable")
            self.shingles[s], first = np.unique(chosen[order], return_index=True)
            self.prefix[s] = own[order], offset[order], np.append(first, len(order))

    def items_of(self, windows: np.ndarray) -> list[str]:
        at = _ranges(self.first[windows], self.first[windows + 1] - self.first[windows])
        return [self.names[i] for i in np.unique(self.item[at]).tolist()]

    def ids(self, texts: list[list[bytes]]) -> np.ndarray:
        """Word numbers of all texts, -1 for words of no item and between texts."""
        n = sum(map(len, texts)) + len(texts)
        return np.fromiter(map(self.vocabulary.get, chain.from_iterable([*t, b""] for t in texts), repeat(-1)), np.int32, n)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for s in self.lengths:
            at, codes = _codes(ids, s)
            table = self.shingles[s]
            if len(at) and len(table):
                number = np.minimum(np.searchsorted(table, codes), len(table) - 1)
                hit = table[number] == codes
                yield s, at[hit], number[hit]

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, stop and window of each verified occurrence of a window."""
        starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, at, number in self.occurrences(ids):
            own, offset, first = self.prefix[s]
            n = first[number + 1] - first[number]
            k = _ranges(first[number], n)
            a, w = np.repeat(at, n) - offset[k], own[k]
            good = (a >= 0) & (a + self.length[w] <= len(ids))
            a, w = a[good], w[good]
            for j in range(self.rows.shape[1]):
                same = (j >= self.length[w]) | (ids[np.minimum(a + j, len(ids) - 1)] == self.rows[w, j])
                a, w = a[same], w[same]
            starts.append(a)
            windows.append(w)
        a, w = np.concatenate(starts), np.concatenate(windows)
        return a, a + self.length[w] if len(w) else a, w


def _slices(column: pa.Array, weight: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about a MB, so that a task holds the words of one run."""
    held, size, start = [], 0, 0
    for i, t in enumerate(column):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > weight:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _rarity(docs: DataFrame, index: Windows) -> dict[int, np.ndarray]:
    """How often the shingles of the windows stand in the texts (column body), for each shingle length."""
    get = shared(docs.sparkSession, index)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = get()
        sums = {s: np.zeros(len(x), np.int64) for s, x in index.shingles.items()}
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                for s, _, number in index.occurrences(index.ids([words_of(t) for t in texts])):
                    sums[s] += np.bincount(number, minlength=len(sums[s]))
        for s, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(k), s, np.int32)), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["s", "k", "n"])

    found = docs.select("body").mapInArrow(count, "s int, k int, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).toArrow()  # at most the shingles of one block
    out = {s: np.zeros(len(x), np.int64) for s, x in index.shingles.items()}
    s, k, n = (found.column(c).to_numpy() for c in "skn")
    for size in out:
        out[size][k[s == size]] = n[s == size]
    get.drop()
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The different items in blocks whose texts have ``block_bytes`` in all, or one longer item."""
    block, size = [], 0
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null").distinct()
    for r in items.toLocalIterator():
        n = len(r.t.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


def _marked(rows: DataFrame, block: list[tuple[str, str]], width: int, shingle: int, only_hits: bool) -> DataFrame:
    """rows (first column, body) with n_words, spans and items of one block of the benchmark; all rows, or those with a hit."""
    index = Windows(block, width, shingle)
    index.choose(_rarity(rows, index))
    get = shared(rows.sparkSession, index)

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = get()
        for batch in batches:
            for start, texts in _slices(batch.column("body")):
                part = batch.slice(start, len(texts))
                words = [words_of(t) for t in texts]
                ends = np.cumsum([len(w) + 1 for w in words])
                a, z, w = index.spans(index.ids(words))
                doc = np.searchsorted(ends, a, "right")
                spans, names = [[] for _ in texts], [[] for _ in texts]
                for d in np.unique(doc).tolist():
                    own, first = doc == d, int(ends[d]) - len(words[d]) - 1
                    spans[d] = [{"start": x, "stop": y} for x, y in _union(list(zip((a[own] - first).tolist(), (z[own] - first).tolist(), strict=True)))]
                    names[d] = index.items_of(np.unique(w[own]))
                new = [pa.array(map(len, words), pa.int32()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))]
                out = pa.record_batch([*part.columns, *new], names=[*part.schema.names, "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(x) for x in spans])) if only_hits else out

    schema = rows.withColumns({"n_words": F.lit(0), "spans": F.lit(None).cast(PASSAGES), "items": F.lit(None).cast("array<string>")}).schema
    return rows.mapInArrow(mark, schema)


def _contaminated(docs: DataFrame, benchmark: DataFrame, width: int, shingle: int, text: str, item: str, block_bytes: int) -> DataFrame:
    """kept (the row without its text), body, n_words, spans, items."""
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[docs[c] for c in docs.columns if c != text]).alias("kept"), docs[text].alias("body"))
    blocks = _blocks(benchmark, item, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _marked(rows, first, width, shingle, only_hits=False)
    texts, found = rows.select(F.xxhash64("body").alias("of"), "body"), None
    for block in chain([first, second], blocks):
        hits = materialise(_marked(texts, block, width, shingle, only_hits=True).select("of", "spans", "items").dropDuplicates(["of"]))
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("of").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row for each block at most
    found = materialise(found.withColumn("spans", merged(F.array_sort("spans"))))
    n_words = F.size(F.filter(F.split("body", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != ""))
    out = rows.withColumn("of", F.xxhash64("body")).join(lookup(found, 32 + 8 * F.size("spans") + 16 * F.size("items")), "of", "left")
    return out.select("kept", "body", F.when(F.col("body").isNull(), 0).otherwise(n_words).alias("n_words"), F.coalesce("spans", F.array().cast(PASSAGES)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 5, text: str = "text", key: str = "doc_id", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, spans (word positions [start, stop) inside windows), items.

    The benchmark is read in blocks of about ``block_bytes`` of text (a longer
    item is a block of its own); the windows of a block are broadcast and the texts
    stream past them, so nothing of the documents is shuffled while there is one block. With more
    blocks each is a job of its own, which holds one block's windows and writes
    a row for each text that has some; these rows are summed up by a 64-bit hash of the text.
    Null text has no words; an item of null or no words has no window; a
    null item_id counts as the empty string; repeated rows are taken one by
    one; with an empty benchmark no word is hit; an empty table gives no row. Further columns of docs play no part.
    """
    found = _contaminated(only(docs, key, text), benchmark, width, shingle, text, item, block_bytes)
    return found.select(F.col(f"kept.`{key}`").alias(key), "n_words", "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shingle: int = 5, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that contain no window of an item."""
    found = _contaminated(docs, benchmark, width, shingle, text, item, block_bytes).where(F.size("spans") == 0)
    return found.select(*[F.col("body").alias(c) if c == text else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents), b as (select item_id, {_SQL_WORDS} as w from benchmark),
item_windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (select *, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
doc_windows as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from item_windows) where len(w) >= n)),
found as (select doc_id, i, x.n, item_id from doc_windows x join item_windows y on x.s = y.s and x.n = y.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by 1)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join items on d.doc_id = items.doc_id"""
