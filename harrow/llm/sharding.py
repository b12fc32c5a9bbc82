"""Shards of near-equal bytes by histogram sort (native)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width, table

_KEYS = 1 << 62  # keys are hashes cut to 62 bits, so cell arithmetic can't overflow
_CELLS = 4096  # of all shards at most, unless there are more shards


def _small(spark: SparkSession, lines: list[dict], schema: str) -> DataFrame:
    """Sums and cuts of the driver as a table, from one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), f"array<struct<{schema}>>")))


def _cells(rows: DataFrame, key: str, within: Column, spans: list[tuple[int, int, int]], fanout: int) -> dict[int, dict[int, int]]:
    """Exact bytes in each of ``fanout`` equal cells of the disjoint key spans (value of ``within``, lo, hi): one aggregation.

    Only sums come to the driver, at most spans x fanout of them.
    """
    lines = [{"i": i, "w": w, "lo": lo, "hi": hi, "step": max(1, -(-(hi - lo) // fanout))} for i, (w, lo, hi) in enumerate(spans)]
    table_ = _small(rows.sparkSession, lines, "i: int, w: long, lo: long, hi: long, step: long")
    inside = (within == F.col("w")) & (F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))
    got = rows.join(F.broadcast(table_), inside).groupBy("i", F.expr(f"({key} - lo) div step").alias("c")).agg(F.sum("size").alias("b"))
    out: dict[int, dict[int, int]] = {}
    for r in got.collect():
        out.setdefault(r.i, {})[r.c] = r.b
    return out


def _refine(rows: DataFrame, key: str, within: Column, open_: dict[int, dict], slack: float, fanout: int) -> None:
    """Narrow each open splitter's span until a probed boundary lies within ``slack`` bytes of its target
    or the span holds one key. A splitter: target, within (value), lo, hi, below (bytes under lo), upto (bytes under hi)."""
    todo = {i: s for i, s in open_.items() if not s["done"]}
    while todo:
        numbers = {span: n for n, span in enumerate(dict.fromkeys((s["within"], s["lo"], s["hi"]) for s in todo.values()))}
        counts = _cells(rows, key, within, list(numbers), fanout)
        for s in todo.values():
            n = numbers[s["within"], s["lo"], s["hi"]]
            lo, hi, step, below = s["lo"], s["hi"], max(1, -(-(s["hi"] - s["lo"]) // fanout)), s["below"]
            for c in sorted(counts.get(n, {})):
                size = counts[n][c]
                if below + size >= s["target"]:
                    s |= {"lo": lo + c * step, "hi": min(hi, lo + (c + 1) * step), "below": below, "upto": below + size}
                    break
                below += size
            else:
                s |= {"lo": hi - 1, "hi": hi, "below": below, "upto": below}
            near = min(("lo", "below"), ("hi", "upto"), key=lambda e: abs(s[e[1]] - s["target"]))
            s["cut"], s["miss"] = s[near[0]], abs(s[near[1]] - s["target"])
            s["done"] = s["miss"] <= slack or s["hi"] - s["lo"] <= 1
        todo = {i: s for i, s in todo.items() if not s["done"]}


def splitters(rows: DataFrame, shards: int, slack: float = 0.0025, group_slack: float = 0.01, fanout: int = 64) -> list[tuple[int, int]]:
    """The shards - 1 keys (h, tie) between shards of near-equal bytes.

    Probing starts with 4096 cells over the whole key space and narrows every
    splitter's cell by ``fanout`` a round. A cut between two groups of equal
    texts is taken when it lies within ``group_slack`` of a shard from its
    target; a larger group is split by ``tie``, a hash of the doc_id.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    share = total / shards
    if not total:
        return [(_KEYS, 0)] * (shards - 1)
    bucket = F.shiftright("h", 50)
    first = {r.b: r.n for r in rows.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).collect()}  # 4096 sums
    open_: dict[int, dict] = {}
    cells, below = iter(sorted(first)), 0
    c = next(cells)
    for i in range(1, shards):
        while below + first[c] < i * share:
            below += first[c]
            c = next(cells)
        open_[i] = {"target": i * share, "within": c, "lo": c << 50, "hi": (c + 1) << 50, "below": below, "upto": below + first[c], "done": False}
    _refine(rows, "h", bucket, open_, slack * share, fanout)
    cuts, inner = {}, {}
    for i, s in open_.items():
        cuts[i] = (s["cut"], 0)
        if s["miss"] > group_slack * share:  # one group of equal texts spans the target
            inner[i] = {"target": s["target"], "within": s["lo"], "lo": 0, "hi": _KEYS, "below": s["below"], "upto": s["upto"], "done": False}
    _refine(rows, "tie", F.col("h"), inner, slack * share, fanout)
    for i, s in inner.items():
        cuts[i] = (s["within"], s["cut"])
    return [cuts[i] for i in range(1, shards)]


def _cell(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with ``cell``, the number of cuts at or before (h, tie): looked up by the first 12 bits of h in a table of 4096 rows."""
    inside: dict[int, list[tuple[int, int]]] = {}
    for h, t in cuts:
        inside.setdefault(h >> 50, []).append((h, t))
    lines, before = [], 0
    for b in range(4096):
        lines.append({"bucket": b, "base": before, "cuts": [{"h": h, "tie": t} for h, t in inside.get(b, [])]})
        before += len(inside.get(b, []))
    table_ = _small(rows.sparkSession, lines, "bucket: long, base: int, cuts: array<struct<h: long, tie: long>>")
    passed = F.filter("cuts", lambda c: (c["h"] < F.col("h")) | ((c["h"] == F.col("h")) & (c["tie"] <= F.col("tie"))))
    found = rows.withColumn("bucket", F.shiftright("h", 50)).join(F.broadcast(table_), "bucket")
    return found.withColumn("cell", F.col("base") + F.size(passed)).drop("bucket", "base", "cuts")


def shard(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows to ``shards`` shards of near-equal bytes (UTF-8 length plus 8 a row).

    Returns key, ``keep`` columns, size, text_crc32, shard and slot (gapless
    from 0 in each shard, in order of text hash and doc_id, so equal texts are
    neighbours). The splitters found by counting decide where a row goes: there are as many
    for each shard as spread it over the session's shuffle partitions (4096 in all at most), and one exchange moves every row to its cell. The search for
    splitters moves sums only. Null text counts as no bytes and, for the checksum, as empty;
    null or repeated doc_ids keep one row each; an empty table gives none. A kept
    column with the name of an output is left out.
    """
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    outputs = ("size", "text_crc32", "shard", "slot")
    names = [key, *(c for c in dict.fromkeys(keep) if c != key and c not in outputs)]
    rows = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("kept"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 2).alias("h"),
        F.shiftrightunsigned(F.xxhash64(docs[key]), 2).alias("tie"),
    )
    rows = materialise(rows)  # without texts: read again by each round of probes
    each = max(1, min(-(-shuffle_width(spark) // shards), _CELLS // shards))  # cells of a shard
    cells = _cell(rows, splitters(rows, shards * each, slack=0.0025 * each, group_slack=0.01 * each))
    dealt = (
        cells.repartitionById(shards * each, F.col("cell"))
        .sortWithinPartitions("h", "tie", "kept.c0")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1), "shard": F.expr(f"cell div {each}").cast("int")})
    )
    dealt = materialise(dealt)
    runs = dealt.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # one row for each cell: their number is set by the job, not by the data
    found = dealt.join(F.broadcast(runs), ["part", "shard"])
    return found.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)], "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
