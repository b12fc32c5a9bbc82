"""Nested JSON as tables of paths and values: search by level, merge, and one canonical text.

A payload is parsed once as a VARIANT and opened one level at a time; how many levels there are is read off the
brackets of the texts beforehand. What concerns one payload alone (its leaves, its canonical text) is done within its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# Where a payload keeps its usage, in this order, and the names of its numbers.
USAGE_KEYS = ["usage_metadata", "token_usage", "usage", "response_metadata", "additional_kwargs"]
PROMPT_KEYS = ["prompt_tokens", "input_tokens"]
COMPLETION_KEYS = ["completion_tokens", "output_tokens"]
TOTAL_KEYS = ["total_tokens"]

STEP = "struct<name:string,at:int>"  # of a path: the name in an object, or the place in an array


def depth(text: Column) -> Column:
    """How many arrays and objects of a JSON text lie in one another at the most."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", ""), "")
    open_ = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, x: F.struct((s["now"] + F.when(x.isin("[", "{"), 1).when(x == "", 0).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(x.isin("[", "{"), 1).otherwise(0)).alias("most")),
    )
    return open_["most"]


def deepest(rows: DataFrame, payload: str) -> int:
    """The greatest depth of all payloads: one pass over them."""
    return rows.agg(F.max(depth(F.col(payload)))).first()[0] or 0


def _entries(value: str | Column) -> Column:
    """The entries of an object; null for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: str | Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def values(rows: DataFrame, keys: list[str], payload: str, arrays: bool = True) -> DataFrame:
    """keys, value (VARIANT) and path of every value at every depth; texts that are no JSON have none. Without ``arrays`` an array is not opened."""
    found = rows.select(*keys, F.try_parse_json(payload).alias("value"), F.array().cast(f"array<{STEP}>").alias("path"), F.lit(True).alias("fresh")).where("value is not null")
    null = F.parse_json(F.lit("null"))

    def inner(value: Column, name: Column, at: Column) -> Column:
        step = F.struct(name.cast("string").alias("name"), at.cast("int").alias("at"))
        return F.struct(F.coalesce(value, null).alias("value"), F.array_append(F.col("path"), step).alias("path"), F.lit(True).alias("fresh"))

    no = F.lit(None)
    for _ in range(deepest(rows, payload)):
        own = F.array(F.struct("value", "path", F.lit(False).alias("fresh")))
        opened = F.transform(F.map_entries(_entries("value")), lambda e: inner(e["value"], e["key"], no))
        if arrays:
            opened = F.coalesce(opened, F.transform(_elements("value"), lambda x, i: inner(x, no, i)))
        found = found.select(*keys, F.explode(F.when(F.col("fresh") & opened.isNotNull(), F.concat(own, opened)).otherwise(own)).alias("v")).select(*keys, "v.*")
    return found.drop("fresh")


def _whole(value: Column, names: list[str]) -> Column:
    """The first of the named entries that is a whole number, as a number or a text; decimals are cut."""
    tried = []
    for n in names:
        text = F.try_variant_get(value, f"$.{n}", "string")
        is_text = F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant")) == "STRING"
        tried.append(F.when(is_text, F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))).otherwise(F.try_variant_get(value, f"$.{n}", "bigint")))
    return F.coalesce(*tried)


def token_usage(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, prompt_tokens, completion_tokens, total_tokens of the first object with any of them: the outermost, then by the entries
    where usage is kept, then by name (JSON objects have no order here) or place. Rows without one are left out; ``keys`` must tell rows apart.
    """
    prompt, completion, total = (_whole(F.col("value"), n) for n in (PROMPT_KEYS, COMPLETION_KEYS, TOTAL_KEYS))
    own = values(rows, keys, payload).where(_entries("value").isNotNull()).select(*keys, "path", prompt.alias("prompt"), completion.alias("completion"), total.alias("total"))
    own = own.withColumn("total", F.coalesce("total", F.col("prompt") + F.col("completion"))).where(F.coalesce("prompt", "completion", "total").isNotNull())
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.lit(USAGE_KEYS), s["name"]), F.lit(0)), F.lit(99))
    rank = F.transform("path", lambda s: F.struct(place(s).alias("kept"), s["name"].alias("name"), s["at"].alias("at")))
    out = own.select(*keys, F.struct(F.size("path").alias("level"), rank.alias("rank")).alias("at"), F.struct("prompt", "completion", "total").alias("u"))
    first = out.groupBy(*keys).agg(F.min_by("u", "at").alias("u"))
    return first.select(*keys, *[F.greatest(F.coalesce(f"u.{n}", F.lit(0)), F.lit(0)).alias(f"{n}_tokens") for n in ("prompt", "completion", "total")])


def _leaves(value: Column, levels: int, arrays: bool = True) -> Column:
    """array<struct<path, text>> of the values in a VARIANT that hold no other, in their order."""
    null, no = F.parse_json(F.lit("null")), F.lit(None)

    def inner(v: Column, x: Column, name: Column, at: Column) -> Column:
        step = F.struct(name.cast("string").alias("name"), at.cast("int").alias("at"))
        return F.struct(F.coalesce(x, null).alias("value"), F.array_append(v["path"], step).alias("path"), F.lit(True).alias("fresh"))

    def opened(v: Column) -> Column:
        named = let(F.map_entries(_entries(v["value"])), lambda e: F.when(F.size(e) > 0, F.transform(e, lambda x: inner(v, x["value"], x["key"], no))))
        placed = let(_elements(v["value"]), lambda e: F.when(F.size(e) > 0, F.transform(e, lambda x, i: inner(v, x, no, i))))
        own = F.array(F.struct(v["value"].alias("value"), v["path"].alias("path"), F.lit(False).alias("fresh")))
        return F.when(v["fresh"], F.coalesce(named, *([placed] if arrays else []), own)).otherwise(own)

    found = F.array(F.struct(value.alias("value"), F.array().cast(f"array<{STEP}>").alias("path"), F.lit(True).alias("fresh")))
    for _ in range(levels):
        found = F.flatten(F.transform(found, opened))
    text = lambda v: F.when(F.is_variant_null(v), F.lit("null")).otherwise(F.to_json(v))
    return F.transform(found, lambda v: F.struct(v["path"].alias("path"), text(v["value"]).alias("text")))


def leaves(rows: DataFrame, keys: list[str], payload: str, arrays: bool = True, levels: int | None = None) -> DataFrame:
    """keys, path, text (JSON) of every value that holds no other: numbers, texts, true, false, null, empty arrays and objects. Without ``arrays`` an array counts as one value.

    ``levels``: no payload is deeper; counted if not given.
    """
    levels = deepest(rows, payload) if levels is None else levels
    parsed = rows.select(*keys, F.try_parse_json(payload).alias("__v")).where("__v is not null")
    return parsed.select(*keys, F.explode(_leaves(F.col("__v"), levels, arrays)).alias("__l")).select(*keys, "__l.*")


def _written(found: Column) -> Column:
    """The JSON of leaves sorted by path, none below another: names in code point order at every depth, ", " and ": " between.

    What stands between two leaves follows from their paths: the ends of all that only the first lies in, and the beginnings of all that only the second does.
    """

    def label(step: Column) -> Column:
        quoted = F.to_json(F.struct(step["name"].alias("n")))
        quoted = F.when(step["name"].rlike("^[A-Za-z0-9_ -]*$"), F.concat(F.lit('"'), step["name"], F.lit('"'))).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
        return F.when(step["name"].isNotNull(), F.concat(quoted, F.lit(": "))).otherwise("")

    def begin(path: Column, first: Column) -> Column:
        steps = F.slice(path, first, F.size(path))
        return F.array_join(F.transform(steps, lambda s: F.concat(F.when(s["name"].isNull(), F.lit("[")).otherwise("{"), label(s))), "")

    def end(path: Column, first: Column) -> Column:
        return F.reverse(F.array_join(F.transform(F.slice(path, first, F.size(path)), lambda s: F.when(s["name"].isNull(), F.lit("]")).otherwise("}")), ""))

    def between(before: Column, path: Column) -> Column:
        differ = F.array_position(F.zip_with(before, path, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        return let(differ, lambda n: F.concat(end(before, n + 1), F.lit(", "), label(F.get(path, n - 1)), begin(path, n + 1)))

    def text(found: Column) -> Column:
        pieces = F.transform(found, lambda x, i: F.concat(F.when(i == 0, begin(x["path"], F.lit(1))).otherwise(between(F.get(found, i - 1)["path"], x["path"])), x["text"]))
        return F.concat(F.array_join(pieces, ""), end(F.get(found, F.size(found) - 1)["path"], F.lit(1)))

    return let(found, text)


def canonical(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, text: the payload with sorted names at every depth; texts that are no JSON are left out. Each row by itself."""
    parsed = rows.select(*keys, F.try_parse_json(payload).alias("__v")).where("__v is not null")
    return parsed.select(*keys, _written(F.sort_array(_leaves(F.col("__v"), deepest(rows, payload)))).alias("text"))


def execution_ids(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, execution_id: the first 16 digits of the SHA-1 of the canonical payload."""
    return canonical(rows, keys, payload).select(*keys, F.substring(F.sha1("text"), 1, 16).alias("execution_id"))


def _settled(rows: DataFrame, by: list[str], order: str, payload: str, levels: int) -> DataFrame:
    """by, found: the leaves of each key's merged payload, sorted by path.

    Leaves are aggregated by key and path first, so only what is different in a key's log meets. A leaf goes if a later value stands at
    its path or above it, or, where it is no object, if later leaves lie below it: both are seen in one window for each depth, all of which run over one sort.
    """
    parsed = rows.select(*by, order, F.try_parse_json(payload).alias("__v"))
    objects = parsed.withColumn("__v", F.when(_entries("__v").isNotNull(), F.col("__v")).otherwise(F.parse_json(F.lit("{}"))))
    found = objects.select(*by, order, F.explode(_leaves(F.col("__v"), levels, arrays=False)).alias("__l")).select(*by, order, "__l.*")
    plain = F.col("text") != "{}"
    at = found.groupBy(*by, "path").agg(F.max(order).alias("last"), F.max_by("text", order).alias("text"), F.max(F.when(plain, F.col(order))).alias("plain"))
    steps = [f"__p{n}" for n in range(levels)]
    at = at.repartition(*by).select("*", F.size("path").alias("size"), *[F.get("path", F.lit(n)).alias(p) for n, p in enumerate(steps)])
    over, under = [F.lit(None)], [F.lit(None)]
    for n in reversed(range(levels)):
        w = Window.partitionBy(*by, *steps[:n])
        at = at.withColumns({f"__o{n}": F.max(F.when(F.col("size") == n, F.col("plain"))).over(w), f"__u{n}": F.max(F.when(F.col("size") > n, F.col("last"))).over(w)})
        over.append(F.when(F.col("size") > n, F.col(f"__o{n}")))
        under.append(F.when(F.col("size") == n, F.col(f"__u{n}")))
    above, below = F.greatest(*over, F.lit(None)), F.coalesce(*under)
    kept = at.where((above.isNull() | (above < F.col("last"))) & (~plain | below.isNull() | (below < F.col("last"))))
    # An empty object is there by itself only where nothing lies in it: what does follows at once.
    full = lambda x, y: (x["text"] == "{}") & F.coalesce(F.slice(y["path"], 1, F.size(x["path"])) == x["path"], F.lit(False))
    all_ = F.sort_array(F.collect_list(F.struct("path", "text")))
    return kept.groupBy(*by).agg(let(all_, lambda s: F.filter(s, lambda x, i: ~full(x, F.get(s, i + 1)))).alias("found"))


def merged(rows: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """by, text: a key's payloads merged in ``order`` (without ties in a key), the later one over the earlier at every depth; arrays as Spark writes them.

    Objects are merged name by name; any other value, arrays too, takes the place of what stood there, and an object
    that of another value. What is no JSON object counts as an empty one.
    """
    return _settled(rows, by, order, payload, deepest(rows, payload)).select(*by, _written(F.col("found")).alias("text"))


def merged_leaves(rows: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """by, path, text of the leaves of each key's merged payload, those in arrays too."""
    levels = deepest(rows, payload)
    found = _settled(rows, by, order, payload, levels).select(*by, F.explode("found").alias("__l")).select(*by, F.col("__l.path").alias("__above"), "__l.text")
    return leaves(found, [*by, "__above"], "text", levels=levels).select(*by, F.concat("__above", "path").alias("path"), "text")
