"""Classification ladders over states, failures and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, normalise, positive_int, string_list

# Texts by which a failure is told, in the order in which they are tried.
FAILURE_HINTS = {
    "timeout": ("transient", ["timeout", "timed out", "超时"]),
    "state_mismatch": ("state_mismatch", ["state mismatch", "dom changed", "element detached"]),
    "rule_stale": ("rule_stale", ["rule stale", "selector stale", "xpath stale", "规则失效"]),
    "site_defense": ("site_defense", ["captcha", "challenge", "429", "access denied", "forbidden", "bot detected"]),
    "fatal": ("fatal", ["fatal", "schema corrupted", "invalid schema", "unsupported"]),
}
# What follows from a category of failure.
ACTIONS = {"transient": "retry", "contract_violation": "reask", "state_mismatch": "replan", "rule_stale": "replan", "site_defense": "human_intervention", "fatal": "fail"}
RETRY_DELAYS = [1.0, 2.0]
TICKET_STATES = ["registered", "queued", "dispatched", "running", "completed", "failed", "expanded", "cancelled", "timeout"]


def _low(x: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(c(x), F.lit(""))))


def snake(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c(x), "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")))


def failure(kind: Column | str, message: Column | str) -> Column:
    """(category, detail) of an error by its type name and message."""
    told = F.concat(snake(kind), F.lit(" "), _low(message))
    out = F.struct(F.lit("fatal").alias("category"), F.lit("unknown_exception").alias("detail"))
    for detail, (category, hints) in reversed(FAILURE_HINTS.items()):
        hit = F.lit(False)
        for h in hints:
            hit = hit | F.contains(told, F.lit(h))
        out = F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(detail).alias("detail"))).otherwise(out)
    return out


def recovery(category: Column | str, failures: Column, most: Column) -> Column:
    """(action, delay_seconds, reason)."""
    known = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    action = F.coalesce(F.try_element_at(known, c(category)), F.lit("fail"))
    reason = F.when(F.map_contains_key(known, c(category)), c(category)).otherwise("unknown_failure_category")
    spent = (action == "retry") & (failures >= F.greatest(most, F.lit(0)))
    delay = F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(F.greatest(failures, F.lit(0)), F.lit(len(RETRY_DELAYS) - 1)).cast("int") + 1)
    return F.struct(
        F.when(spent, "fail").otherwise(action).alias("action"),
        F.when((action == "retry") & ~spent, delay).otherwise(0.0).alias("delay_seconds"),
        F.when(spent, "retry_budget_exhausted").otherwise(reason).alias("reason"),
    )


def run_outcome(total: Column, success: Column, error: Column, invalid: Column, reason: Column) -> Column:
    """(execution_state, outcome_state, promotion_state, terminal_reason, success_rate, failed_count) of a run."""
    failed = F.greatest(total - success, F.lit(0))
    told, err = F.trim(F.coalesce(reason, F.lit(""))), F.coalesce(error, F.lit(""))
    stopped, broke, empty = told == "browser_intervention", err != "", total <= 0
    fine = (failed <= 0) & (invalid == 0)
    outcome = F.when(stopped, "interrupted").when(broke, "system_failure").when(empty, "no_data").when(fine, "success").otherwise("partial_success")
    given = F.when(stopped | (told != ""), told).when(broke, err).when(empty, "no_data_collected").when(fine, "").otherwise("partial_data_available")
    promotion = F.when(outcome == "success", "reusable").when(outcome == "interrupted", "rejected").when(success > 0, "diagnostic_only").otherwise("rejected")
    return F.struct(
        F.when(stopped, "interrupted").when(broke, "failed").otherwise("completed").alias("execution_state"),
        outcome.alias("outcome_state"),
        promotion.alias("promotion_state"),
        given.alias("terminal_reason"),
        F.when(total > 0, F.round(success / total, 4)).otherwise(0.0).alias("success_rate"),
        failed.alias("failed_count"),
    )


def subtask_status(outcome: Column, execution: Column, state: Column, durability: Column, error: Column, success: Column) -> Column:
    kind = _low(outcome)
    return (
        F.when(kind.isin("expanded", "no_data", "system_failure", "business_failure"), kind)
        .when(_low(execution) == "expanded", "expanded")
        .when(_low(state) == "no_data", "no_data")
        .when((F.trim(F.coalesce(error, F.lit(""))) != "") | (_low(state) == "system_failure") | (_low(execution) == "failed"), "system_failure")
        .when(_low(durability) != "durable", "system_failure")
        .when(F.coalesce(success, F.lit(0)) <= 0, "business_failure")
        .otherwise("completed")
    )


def reliable(execution: Column, durability: Column, outcome: Column) -> Column:
    return _low(execution).isin("", "completed") & (_low(durability) == "durable") & ~_low(outcome).isin("no_data", "expanded")


def finalized(durability: Column, claim: Column) -> Column:
    return (_low(durability) == "durable") | _low(claim).isin("committed", "acked", "failed")


def eligible(success: Column, durability: Column, claim: Column) -> Column:
    return F.coalesce(success, F.lit(False)) & (_low(durability) == "durable") & _low(claim).isin("committed", "acked")


def merge_eligibility(known: Column, status: Column, durability: Column, trusted: Column, execution: Column, excluded: list[str]) -> Column:
    """(eligibility, reason) of a subtask for the merged result."""
    why = (
        F.when(~known, "missing_runtime_state")
        .when(status.isin(excluded) | (status != "completed"), F.concat(F.lit("status_"), status))
        .when(_low(durability) != "durable", "subtask_not_durable")
        .when(~F.coalesce(trusted, F.lit(False)), "subtask_not_reliable")
        .when(F.trim(F.coalesce(execution, F.lit(""))) == "", "missing_execution_id")
        .otherwise("")
    )
    return F.struct(F.when(known & status.isin(excluded), "excluded").when(why == "", "included").otherwise("failed").alias("eligibility"), why.alias("reason"))


def target_count(own: Column, per_subtask: Column, whole: Column, grouped: Column) -> Column:
    positive = lambda x: F.when(x > 0, x)
    return F.coalesce(positive(own), F.when(grouped, positive(per_subtask)), positive(whole), positive(per_subtask))


def direct_value(source: Column, fixed: Column, context: Column, url: Column, name: Column) -> Column:
    looks_url = F.lower(name).rlike(r"(^|_)(url|link|href)$")
    return F.when(source == "constant", fixed).when(source == "subtask_context", F.try_element_at(context, name)).when((source == "task_url") | looks_url, url)


def category_path(label: Column | str) -> Column:
    """A label split at its first separator."""
    return F.filter(F.transform(F.split(c(label), r"\s*[-—–:：/|]\s*", 2), lambda p: F.trim(p)), lambda p: p != "")


def backtracks(current: Column, candidate: Column) -> Column:
    """The candidate path is a prefix of the current one, or its only label lies on it."""
    n = F.size(candidate)
    return (n > 0) & ((F.slice(current, 1, F.greatest(n, F.lit(1))) == candidate) | ((n == 1) & F.array_contains(current, F.get(candidate, F.lit(0)))))


def category_cycle(current_url: Column, child_url: Column, current: Column, child: Column) -> Column:
    """The child stays on the same page, its category path is longer than the current one, and its last label lies on that already."""
    named = lambda path: F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), normalise), lambda p: p != "")
    own, below = named(current), named(child)
    same = F.trim(F.coalesce(current_url, F.lit(""))) == F.trim(F.coalesce(child_url, F.lit("")))
    return same & (F.size(own) > 0) & (F.size(below) > F.size(own)) & F.coalesce(F.array_contains(own, F.try_element_at(below, F.lit(-1))), F.lit(False))


def context_like(name: Column, description: Column, aliases: list[str], markers: list[str]) -> Column:
    """A field that repeats its context: its name is an alias, or its description holds a marker; case, white space and underscores don't count."""
    key = lambda x: F.replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")), F.lit("_"), F.lit(""))
    found = key(name).isin(*aliases)
    for m in markers:
        found |= F.contains(key(description), F.lit(m))
    return found


def rate_limited(text: Column | str, url: Column | str) -> Column:
    return _low(text).rlike("too many requests|rate limit|访问频繁|请求过于频繁") | _low(url).rlike("429|ratelimit|too-many")


# The known groupings and ways to find categories.
GROUPINGS, DISCOVERIES = ("none", "category"), ("auto", "manual")


def grouping(group_by: Column, discovery: Column, per_group: Column, total: Column, requested: Column, examples: Column) -> Column:
    """Grouping settings in normal form. Without grouping all but the total is cleared; manual without categories is auto; auto clears what is requested."""
    known = lambda x, names: F.when(F.lower(F.trim(x)).isin(*names), F.lower(F.trim(x))).otherwise(names[0])
    own, none = known(group_by, GROUPINGS), F.array().cast("array<string>")
    on, wanted = own == "category", string_list(requested)
    manual = on & (known(discovery, DISCOVERIES) == "manual") & (F.size(wanted) > 0)
    return F.struct(
        own.alias("group_by"),
        F.when(on, positive_int(per_group)).alias("per_group_target_count"),
        positive_int(total).alias("total_target_count"),
        F.when(manual, "manual").otherwise("auto").alias("category_discovery_mode"),
        F.when(manual, wanted).otherwise(none).alias("requested_categories"),
        F.when(on, string_list(examples)).otherwise(none).alias("category_examples"),
    )
