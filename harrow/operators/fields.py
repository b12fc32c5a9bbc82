"""Field rules and extraction evidence as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xpaths
from ..functions.text import is_blank, normalise
from .history import latest


def item_payload(values: DataFrame, by: list[str], name: str, value: str, pos: str) -> DataFrame:
    """Field values of a record as one map; of a field that comes twice the last counts."""
    last = values.groupBy(*by, name).agg(F.max_by(value, pos).alias("__v"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "__v")))).alias("item"))


def prepare(configs: DataFrame, name: str = "name", xpath: str = "xpath", required: str = "required", source: str = "source", kind: str = "data_type") -> DataFrame:
    """configs with a bucket: valid, missing_required or missing_optional. A URL field without a rule takes the page's URL."""
    direct = F.col(source).isin("constant", "subtask_context", "task_url")
    filled = configs.withColumn(source, F.when(is_blank(xpath) & ~F.coalesce(direct, F.lit(False)) & (F.col(kind) == "url"), "task_url").otherwise(F.col(source)))
    ok = ~is_blank(xpath) | F.coalesce(direct, F.lit(False))
    return filled.withColumn("bucket", F.when(ok, "valid").when(F.col(required), "missing_required").otherwise("missing_optional"))


def complete_samples(values: DataFrame, url: str, required: Column, value: str, xpath: str) -> DataFrame:
    """Records of which every required field has a value and a path."""
    good = ~required | (F.col(value).isNotNull() & ~is_blank(xpath))
    return values.groupBy(url).agg(F.bool_and(good).alias("valid"))


def template_groups(values: DataFrame, url: str, field: str, xpath: str, pos: str, explore: int, validate: int) -> DataFrame:
    """Records grouped by their paths without positions: the first ``explore`` of a group learn, the next ``validate`` check; groups that are too small do neither."""
    part = F.struct(field, xpaths.majority_key(xpath).alias("x"))
    signed = values.groupBy(url).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: F.concat(s[field], F.lit(":"), s["x"])), "|").alias("template"), F.min(pos).alias("__p"))
    sizes = signed.groupBy("template").agg(F.count("*").alias("size"))
    first = latest(signed, ["template"], [F.col("__p"), F.col(url)], explore + validate)  # a few of each template; the others only count
    first = first.select(url, F.row_number().over(Window.partitionBy("template").orderBy("__p", url)).alias("n"))
    ranked = signed.join(first, url, "left").join(sizes, "template")
    role = F.when(F.col("size") < explore, "waiting").when(F.col("n") <= explore, "explore").when(F.col("n") <= explore + validate, "validate").otherwise("extract")
    return ranked.select(url, "template", role.alias("role"))


def merge_profiles(evidence: DataFrame, keys: list[str], pos: str, xpath: str, success: str) -> DataFrame:
    """The last successful evidence with a path for each key; rows of a blank key go."""
    good = F.col(success) & ~is_blank(xpath)
    for k in keys:
        good = good & ~is_blank(k)
    return latest(evidence.where(good), keys, [F.col(pos).desc()])


def merge_documents(existing: DataFrame, incoming: DataFrame, field: str, xpath: str, validated: str, fallbacks: str, most: int = 5) -> DataFrame:
    """Rules of two documents, field by field: a validated path leads, the new one where both or none are; the rest are fallbacks."""
    one = lambda rows, p: rows.select(field, F.col(xpath).alias(f"{p}x"), F.col(validated).alias(f"{p}v"), F.col(fallbacks).alias(f"{p}f"))
    both = one(existing, "o").join(one(incoming, "n"), field, "full_outer")
    keep_old = ~is_blank("ox") & (is_blank("nx") | (F.coalesce("ov", F.lit(False)) & ~F.coalesce("nv", F.lit(False))))
    main = F.when(keep_old, F.col("ox")).otherwise(F.coalesce(F.nullif("nx", F.lit("")), "ox"))
    none = F.array().cast("array<string>")
    rest = F.concat(F.array("nx", "ox"), F.coalesce("nf", none), F.coalesce("of", none))
    chain = F.filter(F.array_distinct(rest), lambda x: (F.coalesce(x, F.lit("")) != "") & (x != F.col(xpath)))
    out = both.withColumn(xpath, main).withColumn(fallbacks, F.slice(chain, 1, most))
    return out.select(field, xpath, (F.coalesce("ov", F.lit(False)) | F.coalesce("nv", F.lit(False))).alias(validated), fallbacks)


def capped_candidates(selected: Column, others: Column, most: int = 20) -> Column:
    """The selected path first, then the others, each once, renumbered."""
    paths = F.slice(F.array_distinct(F.filter(F.concat(F.array(selected), others), lambda x: F.coalesce(x, F.lit("")) != "")), 1, most)
    return F.transform(paths, lambda x, i: F.struct((i + 1).alias("priority"), x.alias("xpath")))


def best_verified(rows: DataFrame, by: str, xpath: str, pos: str, ok: Column, most: int = 8) -> DataFrame:
    """The most stable verified path among the first ``most`` different ones."""
    once = latest(rows, [by, xpath], [F.col(pos)]).withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(pos)))
    return latest(once.where((F.col("__k") <= most) & ok).withColumn("stability", xpaths.stability(xpath)), [by], [F.col("stability").desc(), F.col(pos)]).drop("__k")


def navigation_paths(steps: DataFrame, by: str, step: str, candidates: str, success: Column) -> DataFrame:
    """For each successful click the candidate of least priority (99 if it has none)."""
    rows = steps.where(success).select(by, step, F.posexplode(candidates).alias("i", "c"))
    return rows.groupBy(by, step).agg(F.min_by("c.xpath", F.struct(F.coalesce("c.priority", F.lit(99)), "i")).alias("xpath"))


def unanimous(visits: DataFrame, by: str, xpath: str) -> DataFrame:
    """The path without positions that all visits (two at least) agree on."""
    bare = xpaths.strip_index(xpath)
    n = visits.groupBy(by).agg(F.count("*").alias("visits"), F.count_distinct(bare).alias("different"), F.min(bare).alias("xpath"))
    return n.select(by, F.when((F.col("visits") >= 2) & (F.col("different") == 1), F.col("xpath")).alias("xpath"))


def field_items(sources: list[DataFrame], name: str) -> DataFrame:
    """Field items of several sources, the first source of a name wins; a row's order is its ``pos``."""
    rows = None
    for i, s in enumerate(sources):
        tagged = s.withColumn("source", F.lit(i))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return latest(rows.where(~is_blank(name)), [name], [F.col("source"), F.col("pos")])


def mark_failed(rules: DataFrame, failures: DataFrame, name: str, xpath: str) -> DataFrame:
    """Rules are validated if they have a path and their field is not among the failures."""
    bad = failures.where(~is_blank(name)).select(F.trim(name).alias(name)).distinct().withColumn("__bad", F.lit(True))
    return rules.join(bad, name, "left").withColumn("validated", ~is_blank(xpath) & F.col("__bad").isNull()).drop("__bad")


def disagreements(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Where two extractions of a required field differ after normalising."""
    a, b = first.select(*keys, F.col(value).alias("expected")), second.select(*keys, F.col(value).alias("actual"))
    return a.join(b, keys, "left").where(~normalise(F.coalesce("expected", F.lit(""))).eqNullSafe(normalise(F.coalesce("actual", F.lit("")))))


def step_counts(updates: DataFrame, by: list[str], nodes: str) -> DataFrame:
    """Updates and nodes of a stream of node maps; also sums the maps of resumed runs."""
    return updates.select(*by, F.explode(nodes).alias("node", "n")).groupBy(*by, "node").agg(F.sum("n").alias("steps"))


def step_totals(known: DataFrame, resumed: DataFrame, by: list[str], node: str = "node", steps: str = "steps") -> DataFrame:
    """The steps of each node over a run and its resumptions."""
    columns = [*by, node, steps]
    return known.select(*columns).unionByName(resumed.select(*columns)).groupBy(*by, node).agg(F.sum(steps).alias(steps))


def metrics(samples: DataFrame, name: str, kind: str, value: str, pos: str) -> DataFrame:
    """Counters summed, timings listed in order, rounded."""
    timings = F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == "timing", F.struct(pos, value)))), lambda s: F.round(s[value], 4))
    return samples.groupBy(name).agg(F.sum(F.when(F.col(kind) == "counter", F.col(value))).alias("total"), timings.alias("timings"))
