"""Repeated passages by a sparse suffix array.

Words are runs of anything but ASCII white space, A-Z lower-cased. Suffixes are
retained at minimisers: of any ``least`` = 50 consecutive words, the position whose
21-word gram has the smallest hash of the 30 grams in it. A passage of 50 words that repeats
retains the same position in each occurrence, with at least 21 words to its right.
Retained suffixes whose gram repeats are sorted all over the cluster (those of one
gram in one place), each is compared with its neighbours and every match is extended left and right. That
is all of them where a gram stands at no more than NEIGHBOURS + 1 places. Beyond,
partners may stand anywhere in the group: there the windows of ``least`` words whose
minimiser is the gram are hashed, and those that repeat are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PASSAGES, lookup, matching, materialise, merged, packed, shuffle_width, table
from .neardup import _batches
from .words import hashes, powers, spread

LEAST, GRAM, RIGHT, LEFT, NEIGHBOURS = 50, 21, 56, 32, 3


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from sums of words times powers of an odd base."""
    n = len(words) - size + 1
    up, down = powers(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return spread((sums[size:] - sums[:-size]) * down[:n])


def _least_grams(h: np.ndarray, span: int) -> np.ndarray:
    """For each start of a window of ``span`` grams the position of its smallest hash."""
    return np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1)


def minimisers(words: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The retained positions and their grams."""
    if len(words) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = grams(words, size)
    at = np.unique(_least_grams(h, least - size + 1))
    return at, h[at]


def windows(words: np.ndarray, ats: list[int], least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``least`` words whose minimiser is one of ``ats``: each window of a text has one."""
    chosen = np.zeros(len(words), bool)
    chosen[ats] = True
    starts = np.flatnonzero(chosen[_least_grams(grams(words, size), least - size + 1)])
    return starts, grams(words, least)[starts]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _matches(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Rows in the order of the suffix array; (of, start, stop) of the union of each one's matches with near neighbours."""
    n = len(rows)
    fixed = lambda c, width: np.stack([np.frombuffer(x.ljust(4 * width, b"\0"), ">u4") for x in rows[c]]) if n else np.empty((0, width))
    right, left = fixed("right", RIGHT), fixed("left", LEFT)
    r_len, l_len = rows["right"].str.len().to_numpy() // 4, rows["left"].str.len().to_numpy() // 4
    gram = rows["gram"].to_numpy()
    far_left, far_right = np.full(n, -1), np.full(n, -1)
    for k in range(1, NEIGHBOURS + 1):
        if n <= k:
            break
        i, j = np.arange(n - k), np.arange(k, n)
        r = np.minimum(_shared(right[:-k], right[k:]), np.minimum(r_len[:-k], r_len[k:]))
        x = np.minimum(_shared(left[:-k], left[k:]), np.minimum(l_len[:-k], l_len[k:]))
        good = (gram[:-k] == gram[k:]) & (r + x >= least)
        for at in (i[good], j[good]):
            far_left[at] = np.maximum(far_left[at], x[good])
            far_right[at] = np.maximum(far_right[at], r[good])
    hit = far_right >= 0
    p = rows["at"].to_numpy()
    return pd.DataFrame({"of": rows["of"].to_numpy()[hit], "start": (p - far_left)[hit].astype(np.int32), "stop": (p + far_right)[hit].astype(np.int32)})


def repeated_passages(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: kept (the row as a struct), n_words, passages (array of word positions [start, stop)).

    A word is in a passage if it lies in a run of at least ``least`` words that stands
    in another text too or elsewhere in this one; a text with exact
    copies of ``least`` words or more is one passage. Null, empty and shorter texts have
    none. Texts are told apart by a 64-bit hash, words by 32 bits at each place of a match,
    windows under a frequent gram by a 64-bit hash. An empty table gives no row.
    """
    spark = docs.sparkSession
    docs = packed(docs, body=text).withColumn("of", F.xxhash64("body"))
    size = min(GRAM, least)

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in _batches(batch.column(1)):
                part = batch.slice(start, n)
                found = [minimisers(words, least, size) for words in hashes(part.column(1).to_pylist())]
                of = np.repeat(part.column(0).to_numpy(), [len(a) for a, _ in found])
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([a for a, _ in found]).astype(np.int32)), pa.array(np.concatenate([g for _, g in found]).view(np.int64))], names=["of", "at", "gram"])

    marks = materialise(docs.where("body is not null").select("of", "body").mapInArrow(retain, "of long, at int, gram long"))
    place = F.xxhash64("of", "at")
    often = F.count("*") > NEIGHBOURS + 1  # copies of a text count too: then its gram goes the exact way without need
    twice = materialise(marks.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), often.alias("often")).where("a <> b").select("gram", "often"))
    ats = lambda often: F.collect_set(F.when(F.col("often") == often, F.col("at")))
    hits = materialise(matching(marks, twice, "gram", "of").groupBy("of").agg(ats(False).alias("ats"), ats(True).alias("hot")))  # at most the positions of one text
    texts = docs.select("of", "body").join(lookup(hits.select("of")), "of", "left_semi").dropDuplicates(["of"]).join(hits, "of")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in _batches(batch.column(1), 1 << 20):
                part = batch.slice(start, n)
                found = [windows(words, ats, least, size) for words, ats in zip(hashes(part.column(1).to_pylist()), part.column(2).to_pylist(), strict=True)]
                of = np.repeat(part.column(0).to_numpy(), [len(a) for a, _ in found])
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([a for a, _ in found]).astype(np.int32)), pa.array(np.concatenate([h for _, h in found]).view(np.int64))], names=["of", "start", "window"])

    hot = materialise(texts.where(F.size("hot") > 0).select("of", "body", "hot").mapInArrow(hashed, "of long, start int, window long"))
    again = materialise(hot.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"))
    frequent = hot.join(lookup(again), "window").select("of", "start", (F.col("start") + least).alias("stop"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in _batches(batch.column(1), 1 << 20):
                rows: list[tuple] = []
                ofs, bodies, marked = (c.to_pylist() for c in batch.slice(start, n).columns)
                for of, w, ats in zip(ofs, hashes(bodies), marked, strict=True):
                    h = grams(w, size).view(np.int64)
                    low = (w >> np.uint64(32)).astype(">u4")
                    back = low[::-1]
                    for p in ats:
                        q = len(w) - p
                        rows.append((of, p, int(h[p]), low[p : p + RIGHT].tobytes(), back[q : q + LEFT].tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["of", "at", "gram", "right", "left"])

    kind = "of long, at int, gram long, right binary, left binary"
    order = ["gram", "right", "left", "of", "at"]
    array = texts.where(F.size("ats") > 0).select("of", "body", "ats").mapInArrow(suffixes, kind).repartitionByRange(shuffle_width(spark), "gram").sortWithinPartitions(*order)

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spans of some thousand rows at a time, after the last ones of the rows before."""
        tail = None
        for frame in frames:
            for i in range(0, len(frame), 5000):
                part = frame.iloc[i : i + 5000]
                rows = part if tail is None else pd.concat([tail, part], ignore_index=True)
                yield _matches(rows, least)
                tail = rows.tail(NEIGHBOURS)

    found = array.mapInPandas(neighbours, "of long, start int, stop int")  # a gram has few rows, all in one partition
    spans = found.union(frequent).groupBy("of").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    spans = materialise(spans.select("of", merged("spans").alias("spans")))
    copies = materialise(docs.groupBy("of").agg(F.count("*").alias("n")).where("n > 1 and of is not null").select("of", F.lit(True).alias("copied")))
    n_words = F.coalesce(F.size(F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda x: x != "")), F.lit(0))
    out = docs.select("kept", "of", F.when(F.col("body").isNull(), 0).otherwise(n_words).alias("n_words"))
    out = out.join(lookup(spans, 32 + 8 * F.size("spans")), "of", "left").join(lookup(copies), "of", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("stop"))).cast(PASSAGES)
    found = F.when(F.col("copied") & (F.col("n_words") >= least), whole).otherwise(F.coalesce("spans", F.array().cast(PASSAGES)))
    return out.select("kept", "n_words", found.alias("passages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    n = F.aggregate("passages", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    told = F.array_join(F.transform("passages", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("kept.doc_id", F.col("n_words").cast("long").alias("n_words"), n.alias("n_repeated"), told.alias("passages"), (F.size("passages") > 0).alias("repeated"))


ORACLE = f"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
w as (select doc_id, i, array_to_string(w[i:i + {LEAST - 1}], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {LEAST} + 2)) as i from d where len(w) >= {LEAST})),
again as (select s from w group by 1 having count(*) > 1),
hits as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > {LEAST}, true) as new from w join again on w.s = again.s),
runs as (select doc_id, min(i) - 1 as start, max(i) + {LEAST - 1} as stop from (select *, sum(new::int) over (partition by doc_id order by i) as run from hits) group by doc_id, run),
found as (select doc_id, sum(stop - start)::bigint as n, string_agg(start || '-' || stop, ',' order by start) as passages from runs group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_repeated, coalesce(passages, '') as passages, n is not null as repeated from d left join found on d.doc_id = found.doc_id"""
