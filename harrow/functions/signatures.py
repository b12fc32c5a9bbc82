"""Signatures: SHA-1 over JSON text in one fixed layout (', ' and ': ', keys sorted, nothing but quotes and controls escaped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c


def quoted(x: Column | str) -> Column:
    whole = F.to_json(F.struct(F.coalesce(c(x), F.lit("")).alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def json_object(**values: Column) -> Column:
    """Values are JSON text already; keys are sorted here."""
    parts = [F.concat(F.lit(f'"{k}": '), values[k]) for k in sorted(values)]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def json_map(m: Column) -> Column:
    """A map of strings, by sorted keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", "), F.lit("}"))


def digest(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, length)


def page_state(url: Column, steps: Column) -> Column:
    """url#digest of the URL and the stable part of its navigation steps; the bare URL where there is no step."""
    stable = F.filter(F.transform(steps, string_struct), lambda s: s != "{}")
    raw = json_object(nav_steps=F.concat(F.lit("["), F.array_join(stable, ", "), F.lit("]")), url=quoted(url))
    return F.when(F.size(stable) > 0, F.concat(url, F.lit("#"), digest(raw))).otherwise(url)


def string_struct(m: Column) -> Column:
    """A step as JSON without its empty parts."""
    return json_map(F.map_filter(m, lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != ""))


def semantic_state(url: Column, context: Column) -> Column:
    labels = F.filter(F.transform(F.map_values(context), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.size(labels) > 0, F.concat(url, F.lit("::"), F.array_join(labels, " > "))).otherwise(url)


def strategy(fields: Column, grouping: Column, text: Column) -> Column:
    """The semantic signature of a request: sorted different field names, grouping, description."""
    return digest(json_object(field_names=json_list(F.array_sort(F.array_distinct(fields))), group_by=quoted(F.lower(F.trim(grouping))), task=quoted(F.trim(text))))


def profile(**parts: Column) -> Column:
    return digest(json_object(**{k: quoted(F.trim(F.coalesce(v, F.lit("")))) for k, v in parts.items()}))


def subtask_id(kind: Column, state: Column) -> Column:
    return F.concat(kind, F.lit("_"), digest(state, 10))
