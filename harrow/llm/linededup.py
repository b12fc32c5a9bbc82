"""Cross-site boilerplate lines by distinct-site spread (native).

A line is boilerplate if it stands on at least ``sites`` different sites in
texts that are mostly their own: lines of that spread, wherever they stand, make
up at most half of such a text. So a passage that stands on many sites because whole
documents were copied is no boilerplate; its copies belong to the
near-duplicate operators. Lines of any length count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, matching, packed, table

SITES, OWN = 8, 0.5
_LOG_K, _SIGMAS = 12, 5
_BLANK = " \t\r"


def _line(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def occurrences(docs: DataFrame) -> DataFrame:
    """site, of (hash of the text), line (hash), chars of the line, total (chars of all lines): the different lines of each row, blank ones left out."""
    lines = F.array_distinct(F.filter(F.transform(F.split("body", "\n"), _line), lambda x: x != ""))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    rows = docs.select("site", F.xxhash64("body").alias("of"), lines.alias("lines")).withColumn("total", total)
    return rows.select("site", "of", "total", F.explode(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars")))).alias("l")).select("site", "of", "l.line", "l.chars", "total")


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """The lines (hashes) that stand on at least ``sites`` different sites.

    Lines of fewer occurrences than that, or of one site, need no sketch. The
    others get a HyperLogLog sketch of their sites, merged by the aggregation;
    where the estimate is within five standard errors (at least two) of
    ``sites`` the different sites are counted exactly.
    """
    once = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    some = materialise(once.where((F.col("n") >= sites) & ((F.col("low") != F.col("high")) | F.lit(sites <= 1))).select("line"))
    spread = matching(lines, some, "line", "of").groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(_LOG_K))).alias("sites"))
    spread = materialise(spread)
    margin = max(2.0, sites * _SIGMAS * 1.04 / 2 ** (_LOG_K / 2))
    sure = spread.where(F.col("sites") > sites + margin).select("line")
    near = materialise(spread.where(F.abs(F.col("sites") - sites) <= margin).select("line"))
    exact = matching(lines, near, "line", "of").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line")
    return materialise(sure.union(exact))


def boilerplate(lines: DataFrame, sites: int = SITES, own: float = OWN) -> DataFrame:
    """The lines of that spread over the texts of which they and their like make up a share of at most 1 - ``own``."""
    wide = materialise(matching(lines, spread_lines(lines, sites), "line", "of"))
    shares = wide.groupBy("of", "line").agg(F.max("chars").alias("chars"), F.max("total").alias("total"))  # a text counts once, however often it was copied
    shares = shares.groupBy("of").agg(F.sum("chars").alias("wide"), F.max("total").alias("total"))
    mostly = materialise(shares.where(F.col("wide") <= F.col("total") * (1 - own)).select("of"))
    return spread_lines(materialise(matching(wide, mostly, "of", "line")), sites)


def line_dedup(docs: DataFrame, sites: int = SITES, own: float = OWN, text: str = "text", site: str = "source") -> DataFrame:
    """One row per row of docs: kept (the row as a struct), body (the text without boilerplate), n_lines, n_removed.

    A line is trimmed of blanks, tabs and carriage returns; every occurrence of a boilerplate
    line goes; the other lines stay as they are, blank ones too. Lines and texts are
    told apart by 64-bit hashes. A null site is the site of the empty name; null text has no line and stays
    null; repeated rows are treated alike; an empty table gives none.
    """
    docs = packed(docs, body=text, site=site).withColumn("site", F.xxhash64(F.coalesce("site", F.lit(""))))
    lines = materialise(occurrences(docs))  # the texts are split here, and once more where lines are taken out
    bad = boilerplate(lines, sites, own)
    hits = materialise(matching(lines, bad, "line", "of").groupBy("of").agg(F.collect_set("line").alias("bad")))  # at most the lines of one text
    joined = docs.withColumn("of", F.xxhash64("body")).join(lookup(hits, 32 + 8 * F.size("bad")), "of", "left")
    parts = F.split("body", "\n")
    rest = F.filter(parts, lambda x: ~F.array_contains("bad", F.xxhash64(_line(x))))
    out = joined.select("kept", "body", F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.when(F.col("bad").isNotNull(), rest).alias("rest"))
    out = out.withColumn("n_lines", F.when(F.col("body").isNull(), 0).otherwise(F.col("n_lines")))
    return out.select(
        "kept",
        F.when(F.col("rest").isNotNull(), F.array_join("rest", "\n")).otherwise(F.col("body")).alias("body"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("rest").isNotNull(), F.col("n_lines") - F.size("rest")).otherwise(0).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("kept.doc_id", "n_lines", "n_removed", F.col("body").alias("text"))


ORACLE = f"""
with parts as (
  select doc_id, site, part, pos, trim(part, chr(32) || chr(9) || chr(13)) as line
  from (select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
), wide as (
  select line from parts where line <> '' group by 1 having count(distinct site) >= {SITES}
), own as (
  select doc_id from (select distinct doc_id, line from parts where line <> '') p left join wide w on p.line = w.line
  group by 1 having coalesce(sum(length(p.line)) filter (w.line is not null), 0) <= {1 - OWN} * sum(length(p.line))
), bad as (
  select p.line from parts p join wide w on p.line = w.line join own o on p.doc_id = o.doc_id group by 1 having count(distinct site) >= {SITES}
), marked as (
  select p.doc_id, p.pos, p.part, b.line is not null as gone from parts p left join bad b on p.line = b.line
), joined as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(part, chr(10) order by pos) filter (not gone), '') as text from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, j.text from documents d left join joined j on d.doc_id = j.doc_id
"""
