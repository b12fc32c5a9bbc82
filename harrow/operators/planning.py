"""Plans: candidates and their scopes, journals, artifacts, rules and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states
from .history import latest


def _text(x: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def first_per_scope(candidates: DataFrame, by: list[str], scope: str, pos: str) -> DataFrame:
    """The first candidate of each scope (a category's key, or the signature of a page state) of a plan."""
    return latest(candidates, [*by, scope], [F.col(pos)])


def page_fact_subtasks(candidates: DataFrame, by: list[str], pos: str, requested: Column | None = None, name: str = "name", link: str = "link_text", path: str = "path", key: str = "scope_key", label: str = "scope_label", task: str = "task_description") -> DataFrame:
    """Subtasks from the categories found on a page: named ones, requested ones if some are, each scope once, in order.

    ``requested``: an array of wanted labels or path parts, compared in lower case; null takes all.
    """
    named = candidates.withColumn("name", F.when(_text(name) != "", _text(name)).otherwise(_text(link))).where("name <> ''")
    if requested is not None:
        own = F.transform(F.concat(F.array("name"), F.col(path)), lambda p: F.lower(F.trim(p)))
        named = named.where(requested.isNull() | F.arrays_overlap(own, F.transform(requested, lambda p: F.lower(F.trim(p)))))
    scoped = named.withColumn("scope", states.scope(F.col(key), F.col(label), F.col(path)))
    scoped = scoped.withColumns({key: F.coalesce("scope.key", F.concat(F.lit("category:"), F.lower("name"))), label: F.coalesce("scope.label", "name")}).drop("scope")
    return first_per_scope(scoped, by, key, pos).withColumn(task, F.when(_text(task) != "", _text(task)).otherwise(F.concat(F.lit("collect: "), "name")))


def merge_journal(known: DataFrame, incoming: DataFrame, by: list[str], pos: str, keys: tuple[str, ...] = ("entry_id", "phase", "action", "created_at")) -> DataFrame:
    """known and the incoming entries whose keys are new, each once. A missing entry_id is made from plan and position."""
    made = incoming.withColumn(keys[0], F.when(_text(keys[0]) != "", F.col(keys[0])).otherwise(F.concat_ws("_", F.lit("runtime"), *by, pos)))
    clean = lambda rows: rows.withColumns({k: _text(F.col(k).cast("string")) for k in keys})
    new = latest(clean(made), [*by, *keys], [F.col(pos)]).join(clean(known).select(*by, *keys).distinct(), [*by, *keys], "left_anti")
    return clean(known).unionByName(new.select(*known.columns))


def first_entries(journal: DataFrame, by: list[str], node: str, pos: str, most: int) -> DataFrame:
    """The first ``most`` journal entries of each node."""
    return latest(journal, [*by, node], [F.col(pos)], most)


def artifacts(rows: DataFrame, by: list[str], label: str, path: str, pos: str) -> DataFrame:
    """The first of each (label, path); without a path there is none."""
    clean = rows.withColumns({label: F.coalesce(F.col(label), F.lit("")), path: F.coalesce(F.col(path), F.lit(""))}).where(F.col(path) != "")
    return latest(clean, [*by, label, path], [F.col(pos)])


def mark_paths(marks: DataFrame, by: list[str], mark: str, xpath: str, priority: str) -> DataFrame:
    """An array of the paths of each mark, by priority; one by its data attribute where it has none."""
    own = marks.groupBy(*by, mark).agg(F.transform(F.array_sort(F.collect_list(F.when(_text(xpath) != "", F.struct(priority, xpath)))), lambda s: s[xpath]).alias("paths"))
    made = F.array(F.concat(F.lit('//*[@data-som-id="'), F.col(mark).cast("string"), F.lit('"]')))
    return own.withColumn("paths", F.when(F.size("paths") > 0, F.col("paths")).otherwise(made))


def seeded_skills(skills: DataFrame, by: list[str], pos: str, host: Column, eligible: Column, most: int = 3, path: str = "path", domain: str = "domain") -> DataFrame:
    """The first ``most`` skills of a run: eligible, of this host or of no domain, each path once."""
    good = skills.where((_text(path) != "") & eligible & ((_text(host) == "") | (_text(domain) == "") | (_text(domain) == _text(host))))
    return latest(latest(good, [*by, path], [F.col(pos)]), by, [F.col(pos)], most)


def field_rules(sources: DataFrame, configs: DataFrame, failed: DataFrame, by: list[str], rank: str, name: str = "name", xpath: str = "xpath") -> DataFrame:
    """The rules of the first source that has fields (least ``rank``), paths from the configuration first; validated
    where there is a path and the field is not among the failed ones."""
    named = sources.withColumn(name, _text(name))
    first = F.min(rank).over(Window.partitionBy(*by))
    used = named.withColumn("first", first).where((F.col(rank) == F.col("first")) & (F.col(name) != "")).drop("first")
    config = configs.select(*by, _text(name).alias(name), _text(xpath).alias("__own"))
    bad = failed.select(*by, _text(name).alias(name), F.lit(True).alias("__failed")).distinct()
    out = used.join(config, [*by, name], "left").join(bad, [*by, name], "left")
    path = F.when(_text("__own") != "", _text("__own")).otherwise(_text(xpath))
    return out.withColumn(xpath, path).withColumn("validated", (F.col(xpath) != "") & F.col("__failed").isNull()).drop("__own", "__failed")


def rules_ready(rules: DataFrame, by: list[str], ready: Column) -> DataFrame:
    """Per key whether all of its rules are ready."""
    return rules.groupBy(*by).agg(F.bool_and(ready).alias("ready"))


def hydrate(messages: DataFrame, payloads: DataFrame, key: str = "data_id") -> DataFrame:
    """Messages (a batch or a stream) with their payloads; those without one are dropped."""
    return messages.join(payloads, key)


def until(found: DataFrame, by: list[str], page: str, pos: str, url: str, target: int, pages: int) -> DataFrame:
    """The URLs that a collection keeps: the first of each, page by page, up to ``pages``, until ``target`` are there."""
    once = latest(found.where(F.col(page) <= pages), [*by, url], [F.col(page), F.col(pos)])
    return latest(once, by, [F.col(page), F.col(pos)], target)


def with_signature(incoming: DataFrame, known: DataFrame, keys: list[str], computable: Column, computed: Column, signature: str = "semantic_signature") -> DataFrame:
    """Incoming tasks with their signature: computed where its inputs are there, else the one passed. A new task without one is an error."""
    own = incoming.withColumn(signature, F.when(computable, computed).otherwise(_text(signature)))
    there = known.select(*keys).distinct().withColumn("__known", F.lit(True))
    checked = own.join(there, keys, "left")
    missing = (F.col(signature) == "") & F.col("__known").isNull()
    return checked.withColumn(signature, F.when(missing, F.raise_error(F.lit("missing_semantic_signature"))).otherwise(F.col(signature))).drop("__known")
