"""Column builders for actions, states of page elements, results and their envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

# Words that mark an active element, ARIA values of a current one, other names of actions, and the status of each outcome.
ACTIVE = ["active", "selected", "current", "checked"]
CURRENT = ["true", "page", "step", "location"]
ACTION_NAMES = {"scroll_down": "scroll", "scroll_up": "scroll", "press": "retry"}
RESULT_STATUS = {"completed": "success", "success": "success", "expanded": "expanded", "system_failure": "failed", "business_failure": "failed", "no_data": "failed"}
CATEGORY_FIELDS = ["category", "category_name", "分类", "所属分类"]


def _low(x: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(c(x), F.lit(""))))


def _given(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


def action(name: Column | str, args: Column) -> Column:
    """The name of an action, other names resolved; without one it is told from its arguments (a map of strings)."""
    low = _low(name)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in ACTION_NAMES.items() for v in pair]), low), low)
    arg = lambda k: F.try_element_at(args, F.lit(k))
    there = F.exists(F.array(*[arg(k) for k in ("items", "input", "button", "found")]), lambda v: v.isNotNull())
    guess = (
        F.when(_given(arg("text")) & _given(arg("target_text")), "type")
        .when(arg("scroll_delta").isNotNull(), "scroll")
        .when(_given(arg("url")), "navigate")
        .when(_given(arg("purpose")) & there, "select")
        .when(_given(arg("target_text")), "click")
        .otherwise("")
    )
    return F.when(low != "", named).otherwise(guess)


def selected(state: Column) -> Column:
    """Whether an element (a map with class_name, aria_selected, aria_current, data_state) is the active one."""
    at = lambda k: F.lower(F.coalesce(F.try_element_at(state, F.lit(k)), F.lit("")))
    by_class = F.exists(F.array(*map(F.lit, ACTIVE)), lambda w: F.contains(at("class_name"), w))
    return F.coalesce(by_class | (at("aria_selected") == "true") | at("aria_current").isin(CURRENT) | at("data_state").isin(ACTIVE), F.lit(False))


def activated(before: Column, after: Column) -> Column:
    """The element became the active one."""
    return selected(after) & ~selected(before)


def stable_step(step: Column) -> Column:
    """The parts of a navigation step (a map of strings) that tell one step from another: trimmed, the action in lower case, others left out."""
    names = ["action", "target_text", "text", "key", "url", "scroll_delta"]
    own = F.map_filter(step, lambda k, v: k.isin(names))
    return F.transform_values(own, lambda k, v: F.when(k == "action", F.lower(F.trim(v))).when(k == "scroll_delta", v).otherwise(F.trim(F.coalesce(v, F.lit("")))))


def result_status(outcome: Column | str, status: Column | str) -> Column:
    """success, expanded or failed for the outcome of a subtask, or its status where there is none."""
    known = F.create_map(*[F.lit(v) for pair in RESULT_STATUS.items() for v in pair])
    first = F.when(_given(c(outcome)), c(outcome)).otherwise(c(status))
    return F.coalesce(F.try_element_at(known, _low(first)), F.lit("failed"))


def violation(component: Column, action_: Column, response: Column, raw: Column, errors: Column, page: Column) -> Column:
    """The failure record of an answer that breaks its protocol."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    detail = F.struct(text(action_).alias("action"), text(response).alias("response_text"), raw.alias("raw_payload"), F.coalesce(errors, F.array().cast("array<string>")).alias("validation_errors"))
    return F.struct(text(page).alias("page_id"), F.lit("contract_violation").alias("category"), F.lit("invalid_protocol_message").alias("detail"), text(component).alias("component"), detail.alias("metadata"))


def envelope(data: Column, errors: Column, metrics: Column, trace: Column) -> Column:
    """status, data, errors, metrics, trace_id: success without errors, partial with errors and data, else failed."""
    none = F.size(F.coalesce(errors, F.array().cast("array<string>"))) == 0
    status = F.when(none, "success").when(data.isNotNull(), "partial").otherwise("failed")
    return F.struct(status.alias("status"), data.alias("data"), errors.alias("errors"), metrics.alias("metrics"), trace.alias("trace_id"))


def iso(at: Column | str) -> Column:
    """ISO 8601 text of a timestamp, microseconds only where there are some; '' for null."""
    v = c(at)
    whole = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(v, "SSSSSS")
    return F.coalesce(F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros)), F.lit(""))


def scope(key: Column, label: Column, path: Column) -> Column:
    """key, label and path of a category: what is given, else made from the path."""
    low = F.filter(F.transform(path, _low), lambda p: p != "")
    made = F.when(F.size(low) > 0, F.concat(F.lit("category:"), F.array_join(low, " > ")))
    own = lambda x, other: F.coalesce(F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")), other)
    return F.struct(own(key, made).alias("key"), own(label, F.when(F.size(path) > 0, F.array_join(path, " > "))).alias("label"), path.alias("path"))


def fixed_fields(label: Column) -> Column:
    """The fields that a category's label settles; none for a blank label."""
    return F.when(_given(label), F.create_map(*[x for k in CATEGORY_FIELDS for x in (F.lit(k), label)])).otherwise(F.create_map().cast("map<string,string>"))


def concurrency(consumers: Column, dispatched: Column, budget: Column, serial: Column, default_consumers: int = 3, default_dispatched: int = 1) -> Column:
    """Positive numbers or their defaults; serial work has one of each."""
    positive = lambda x, other: F.coalesce(F.when(x > 0, x), other)
    one = F.coalesce(serial, F.lit(False))
    a, b = positive(consumers, F.lit(default_consumers)), positive(dispatched, F.lit(default_dispatched))
    pick = lambda x: F.when(one, 1).otherwise(x)
    return F.struct(pick(a).alias("consumers"), pick(b).alias("dispatched"), pick(positive(budget, F.greatest(a, b, F.lit(1)))).alias("budget"))


def rule_ready(required: Column, xpath: Column, source: Column, kind: Column) -> Column:
    """A rule that is not required, has a path, or gets its value without one."""
    return ~F.coalesce(required, F.lit(False)) | _given(xpath) | _low(source).isin("constant", "subtask_context", "task_url") | (_low(kind) == "url")


def reusable_config(status: Column, xpath: Column) -> Column:
    return (F.trim(F.coalesce(status, F.lit(""))) == "validated") & _given(xpath)
