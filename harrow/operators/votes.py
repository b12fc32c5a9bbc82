"""Consensus over extraction paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xpaths
from ..functions.text import safe_divide
from ..sources.shared import cut


def ranked(rows: DataFrame, by: list[str], xpath: str, pos: str) -> DataFrame:
    """Each different path of a key: support, stability, first position and rank (support, stability, first seen)."""
    clean = rows.withColumn(xpath, F.trim(F.col(xpath))).where(F.coalesce(F.col(xpath), F.lit("")) != "")
    votes = clean.groupBy(*by, xpath).agg(F.count("*").alias("support"), F.min(pos).alias("first_seen")).withColumn("stability", xpaths.stability(xpath))
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.col("support").desc(), F.col("stability").desc(), "first_seen", xpath)
    return votes.withColumns({"votes": F.sum("support").over(whole), "rank": F.row_number().over(order)})


def exact_vote(rows: DataFrame, by: list[str], xpath: str, pos: str) -> DataFrame:
    """The main path of each key with its support; the others in order of rank.

    A share of half makes it dominant; without one the best ranked is taken all the same.
    """
    r = ranked(rows, by, xpath, pos)
    main = F.max(F.when(F.col("rank") == 1, F.struct(xpath, "support", "stability"))).alias("m")
    rest = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", xpath)))).alias("rest")
    out = r.groupBy(*by).agg(main, rest, F.first("votes").alias("votes"))
    share = safe_divide(F.col("m.support"), F.col("votes"))
    return out.select(*by, F.col(f"m.{xpath}").alias(xpath), F.col("m.support").alias("support"), F.round(share, 4).alias("support_rate"), (share >= 0.5).alias("dominant"), F.transform("rest", lambda s: s[xpath]).alias("fallbacks"))


def confidence(xpath: Column, pattern: Column) -> Column:
    """Aggregate: 0.7 of the exact matches and 0.3 of those without positions."""
    exact = F.avg((F.trim(xpath) == F.trim(pattern)).cast("double"))
    shape = F.avg((xpaths.strip_index(F.trim(xpath)) == xpaths.strip_index(F.trim(pattern))).cast("double"))
    return 0.7 * exact + 0.3 * shape


def segment_consensus(rows: DataFrame, by: list[str], xpath: str, pos: str, majority: float = 0.67, accept: float = 0.5) -> DataFrame:
    """One pattern from the paths of the commonest depth: tags must agree, positions stay where a
    share of ``majority`` has the same, predicates where all have them.

    Different paths carry weights, so rows are aggregated before anything is parsed; the paths and their segments, read twice, are a table in the shared folder. Votes for positions and
    predicates are counted in one aggregation, patterns made for every depth, and the depth chosen last;
    ``majority`` = 1 and ``accept`` = 0.6 give the strict form for links.
    """
    paths = rows.groupBy(*by, F.trim(F.col(xpath)).alias("__p")).agg(F.count("*").alias("__w"), F.min(pos).alias("__f"))
    named = cut(paths.withColumn("__s", xpaths.segments("__p")).withColumn("__n", F.size("__s")))
    place = [*by, "__n", "__i"]
    votes = F.transform(F.array_distinct("__x.attributes"), lambda q: F.struct(F.lit(True).alias("named"), q.alias("value")))
    position = F.array(F.struct(F.lit(False).alias("named"), F.col("__x.index").cast("string").alias("value")))
    ballots = named.select(*by, "__n", "__w", "__f", F.posexplode("__s").alias("__i", "__x")).select(*place, "__w", "__f", "__x", F.explode(F.concat(position, votes)).alias("__v"))
    counted = ballots.groupBy(*place, "__v").agg(F.sum("__w").alias("__votes"), F.min("__f").alias("__first"), F.min("__x.tag").alias("__low"), F.max("__x.tag").alias("__high"), F.min_by("__x", "__f").alias("__x"))
    at, is_at = F.col("__v.value"), ~F.col("__v.named")
    counted = counted.withColumn("__rows", F.sum(F.when(is_at, F.col("__votes"))).over(Window.partitionBy(*place)))
    step = counted.groupBy(*place).agg(
        F.max_by(at, F.when(is_at, F.struct("__votes", (-F.col("__first")).alias("f")))).alias("__at"),
        F.max(F.when(is_at, F.col("__votes"))).alias("__top"),
        F.first("__rows").alias("__rows"),
        F.min("__first").alias("__first"),
        F.bool_or(is_at & at.isNull()).alias("__none"),
        (F.min("__low") != F.max("__high")).alias("__mixed"),
        F.min_by("__x", "__first").alias("__x"),
        F.array_join(F.array_sort(F.collect_list(F.when(~is_at & (F.col("__votes") == F.col("__rows")), at))), "").alias("__shared"),
    )
    keep = ~F.col("__none") & (F.col("__top") / F.col("__rows") >= majority)
    text = F.concat("__x.separator", "__x.tag", F.when(keep, F.concat(F.lit("["), "__at", F.lit("]"))).otherwise(""), "__shared")
    depths = step.groupBy(*by, "__n").agg(F.array_sort(F.collect_list(F.struct("__i", text.alias("text")))).alias("__all"), F.bool_or("__mixed").alias("__mixed"), F.max("__rows").alias("__rows"), F.min("__first").alias("__first"))
    best = depths.groupBy(*by).agg(F.max_by(F.struct("__n", "__all", "__mixed"), F.struct("__rows", (-F.col("__first")).alias("f"))).alias("__b"))
    pattern = best.where("not __b.__mixed").select(*by, "__b.__n", F.array_join(F.transform("__b.__all", lambda s: s["text"]), "").alias("pattern"))
    exact, shape = F.col("__p") == F.col("pattern"), xpaths.strip_index("__p") == xpaths.strip_index("pattern")
    # In whole tenths and one division, so a confidence that is a half in its last digit is rounded up as its exact value.
    tenths = F.sum(F.col("__w") * (F.when(exact, 7).otherwise(0) + F.when(shape, 3).otherwise(0)))
    scored = named.drop("__s").join(pattern, [*by, "__n"]).groupBy(*by, "pattern").agg(F.round(tenths / (F.sum("__w") * 10), 4).alias("confidence"), F.sum("__w").alias("support"))
    return scored.where(F.col("confidence") >= accept)


def index_free_mode(rows: DataFrame, by: list[str], xpath: str, pos: str, accept: float = 0.5) -> DataFrame:
    """The commonest path without positions, if its share is large enough."""
    bare = rows.withColumn("pattern", xpaths.strip_index(F.trim(F.col(xpath)))).where("pattern <> ''")
    votes = bare.groupBy(*by, "pattern").agg(F.count("*").alias("support"), F.min(pos).alias("first_seen"))
    w = Window.partitionBy(*by)
    best = votes.withColumns({"votes": F.sum("support").over(w), "n": F.row_number().over(w.orderBy(F.col("support").desc(), "first_seen", "pattern"))})
    return best.where((F.col("n") == 1) & (F.col("support") / F.col("votes") >= accept)).select(*by, "pattern", "support", "votes")


def suffix_consensus(rows: DataFrame, by: list[str], xpath: str) -> DataFrame:
    """The longest common run of tags at the end of all paths, as //..., if it has two steps at least. Only different paths are parsed."""
    paths = rows.groupBy(*by, F.trim(F.col(xpath)).alias("__p")).agg(F.count("*").alias("__w"))
    tags = F.reverse(F.transform(xpaths.steps("__p"), lambda s: s["tag"]))
    steps = paths.select(*by, "__w", F.posexplode(tags).alias("i", "tag"))
    n = paths.groupBy(*by).agg(F.sum("__w").alias("paths"))
    level = steps.groupBy(*by, "i").agg(F.sum("__w").alias("rows"), F.min("tag").alias("tag"), F.max("tag").alias("other")).join(n, by)
    broken = (F.col("tag") != F.col("other")) | (F.col("rows") != F.col("paths"))
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    good = level.withColumn("b", F.max(broken.cast("int")).over(w)).where("b = 0")
    out = good.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), "tag"))).alias("all"))
    return out.where(F.size("all") >= 2).select(*by, F.concat(F.lit("//"), F.array_join(F.transform("all", lambda s: s["tag"]), "/")).alias("pattern"))


def by_strategy(candidates: DataFrame, by: list[str], record: str, strategy: str, xpath: str, order: tuple[str, ...] = ("id", "testid", "class-anchor", "id-relative", "data-attr")) -> DataFrame:
    """The first strategy, in order, whose one path all records of a key have."""
    n = candidates.groupBy(*by).agg(F.count_distinct(record).alias("records"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(strategy))
    votes = candidates.where(rank > 0).groupBy(*by, strategy, xpath).agg(F.count_distinct(record).alias("have"), F.min(rank).alias("rank")).join(n, by)
    return votes.where("have = records").groupBy(*by).agg(F.min(F.struct("rank", strategy, xpath)).alias("m")).select(*by, f"m.{strategy}", f"m.{xpath}")


def union_pattern(rows: DataFrame, by: list[str], xpath: str, pos: str) -> DataFrame:
    """'a | b' for a key with exactly two paths, if they differ in more than positions."""
    once = rows.groupBy(*by, xpath).agg(F.min(pos).alias("first"))
    two = once.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(xpaths.strip_index(xpath)).alias("shapes"), F.min_by(xpath, F.struct("first", xpath)).alias("a"), F.max_by(xpath, F.struct("first", xpath)).alias("b"))
    return two.where("n = 2 and shapes = 2").select(*by, F.concat_ws(" | ", "a", "b").alias("pattern"))


def prefers_union(union: Column, current: Column) -> Column:
    """By the confidences of both patterns."""
    return (union >= 0.75) & (union >= current + 0.25)


def union_choice(rows: DataFrame, by: list[str], xpath: str, pos: str) -> DataFrame:
    """by, pattern, current, preferred, main, other: for keys whose paths are two, of two shapes, whether 'a | b' is better than the more frequent one alone.

    The union covers all rows of such a key, so its confidence is 1; that of one path is its share, as it alone has its shape.
    ``main`` is the path with more support, or else the more stable, or else the earlier one.
    """
    once = rows.where(F.trim(xpath) != "").groupBy(*by, xpath).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    rank, seen = F.struct(-F.col("n"), -xpaths.stability(xpath), "first", xpath), F.struct("first", xpath)
    two = once.groupBy(*by).agg(
        F.count("*").alias("paths"), F.count_distinct(xpaths.strip_index(xpath)).alias("shapes"), (F.max("n") / F.sum("n")).alias("current"),
        F.min_by(xpath, seen).alias("a"), F.max_by(xpath, seen).alias("b"), F.min_by(xpath, rank).alias("main"), F.max_by(xpath, rank).alias("other"),
    )
    return two.where("paths = 2 and shapes = 2").select(*by, F.concat_ws(" | ", "a", "b").alias("pattern"), F.round("current", 4).alias("current"), prefers_union(F.lit(1.0), F.col("current")).alias("preferred"), "main", "other")


def union_chain(patterns: DataFrame, rows: DataFrame, by: list[str], pattern: str, xpath: str) -> DataFrame:
    """A union's parts by how often the key's paths are that part: the main one and the others."""
    parts = patterns.select(*by, F.posexplode(F.split(pattern, r" \| ")).alias("i", xpath))
    votes = rows.groupBy(*by, xpath).agg(F.count("*").alias("support"))
    ranked_ = parts.join(votes, [*by, xpath], "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("support", F.lit(0))).alias("s"), "i", xpath))).alias("all"))
    return ranked_.select(*by, F.transform("all", lambda s: s[xpath]).alias("chain"))


def mean_similarity(rows: DataFrame, by: list[str], xpath: str) -> DataFrame:
    """Mean similarity of all pairs of a key's paths.

    The similarity is the share of the longer path's steps that are equal at the same place, so the sum over
    pairs is one over places: how many paths of each length have a step there. No pair is formed.
    """
    bare = rows.withColumn("x", xpaths.bare(xpath)).where("x <> ''").groupBy(*by, "x").agg(F.count("*").alias("n")).withColumn("s", F.split("x", "/"))
    place = [*by, "i", "v"]
    counted = bare.select(*by, "n", F.size("s").alias("l"), F.posexplode("s").alias("i", "v")).groupBy(*place, "l").agg(F.sum("n").alias("n"))
    shorter = F.coalesce(F.sum("n").over(Window.partitionBy(*place).orderBy("l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = (F.col("n") * shorter + F.col("n") * (F.col("n") - 1) / 2) / F.col("l")
    sums = counted.withColumn("shares", shares).groupBy(*by).agg(F.sum("shares").alias("s"), F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("k"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return sums.select(*by, F.when(F.col("k") == 1, 1.0).otherwise(F.round(F.col("s") / pairs, 4)).alias("stability"))


def validation(rows: DataFrame, page: str, field: str, ok: Column, required: Column, field_rate: float = 0.8, page_rate: float = 0.8) -> DataFrame:
    """Per field: its rate and whether it is validated; with the share of pages where all required fields hold."""
    fields = rows.groupBy(field).agg(F.round(F.avg(ok.cast("double")), 4).alias("rate"), F.bool_or(required).alias("required"))
    pages = rows.groupBy(page).agg(F.bool_and(ok | ~required).alias("good")).agg(F.round(F.avg(F.col("good").cast("double")), 4).alias("page_rate"))
    out = fields.withColumn("validated", F.col("rate") >= field_rate).crossJoin(F.broadcast(pages))  # pages: one row
    every = F.bool_and(F.col("validated") | ~F.col("required")).over(Window.partitionBy())
    return out.withColumn("accepted", (F.col("page_rate") >= page_rate) & every)
