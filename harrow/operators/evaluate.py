"""Evaluation of extracted records against the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_divide, similarity


def _value(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def _numeric(a: Column, e: Column) -> Column:
    return F.abs(a.cast("double") - e.cast("double")) <= 0.01  # raises for what is no number, as ANSI casts do


def _numeric_lenient(a: Column, e: Column) -> Column:
    return F.coalesce(F.abs(a.try_cast("double") - e.try_cast("double")) <= 0.01, F.lit(False))


def _fuzzy(a: Column, e: Column) -> Column:
    return F.contains(a, e) | F.contains(e, a) | (similarity(a, e) >= 0.85)


MATCHERS: dict[str, Callable[[Column, Column], Column]] = {
    "exact": lambda a, e: a == e,
    "numeric_tolerance": _numeric,
    "numeric_lenient": _numeric_lenient,
    "fuzzy": _fuzzy,
    "contains": lambda a, e: F.contains(a, e),
}


def field_match(actual: Column, expected: Column, strategy: str) -> Column:
    if strategy not in MATCHERS:
        raise ValueError(f"no such strategy: {strategy}")
    return MATCHERS[strategy](_value(actual), _value(expected))


def align(actual: DataFrame, expected: DataFrame, key: str, pos: str) -> DataFrame:
    """status (matched, unmatched_actual, unmatched_expected), key, and the two rows as structs a and e.

    Keys are trimmed; the first expected row of a key counts; each matches the first actual row of it; rows without a key and further actual rows stay unmatched.
    """

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.nullif(_value(F.col(key)), F.lit("")).alias("key"), F.struct(*rows.columns).alias(name), F.col(pos).alias("p"))

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.where("key is not null").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("p")))

    found = named(actual, "a")
    a, e = numbered(found), numbered(named(expected, "e")).where("n = 1")
    both = a.join(e.select("key", "e", F.lit(1).alias("n")), ["key", "n"], "full_outer")
    status = F.when(F.col("a").isNull(), "unmatched_expected").when(F.col("e").isNull(), "unmatched_actual").otherwise("matched")
    both = both.select(status.alias("status"), "key", "a", "e")
    # Rows without a key go past the window and the join, where they would meet in one task.
    bare = found.where("key is null").select(F.lit("unmatched_actual").alias("status"), "key", "a")
    return both.unionByName(bare, allowMissingColumns=True)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(safe_divide(2 * p * r, p + r), 6)}


def record_metrics(aligned: DataFrame) -> DataFrame:
    n = aligned.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "unmatched_actual", "unmatched_expected")])
    return n.withColumns(prf(F.col("matched"), F.col("unmatched_actual"), F.col("unmatched_expected")))


def present(x: Column) -> Column:
    return _value(x) != ""


def field_metrics(aligned: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Per field: values present on either side, matches among aligned pairs, precision, recall, F1."""
    rows = aligned.select("status", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("a"), F.col(f"e.{f}").cast("string").alias("e"), _both(f, s).alias("ok")) for f, s in strategies.items()])).alias("x"))
    n = rows.select("status", "x.*").groupBy("field").agg(F.count_if(present(F.col("a"))).alias("n_actual"), F.count_if(present(F.col("e"))).alias("n_expected"), F.count_if("ok").alias("n_correct"))
    c = F.col("n_correct")
    return n.withColumns(prf(c, F.col("n_actual") - c, F.col("n_expected") - c))


def macro_f1(fields: DataFrame) -> DataFrame:
    """The mean of the fields' F1; 0 without fields."""
    return fields.agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("macro_f1"))


def _both(field: str, strategy: str) -> Column:
    a, e = F.col(f"a.{field}"), F.col(f"e.{field}")
    return F.when((F.col("status") == "matched") & present(a) & present(e), field_match(a, e, strategy)).otherwise(False)


def exact_match_rate(aligned: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Share of aligned pairs of which every field matches; absent values are not excused."""
    every = F.lit(True)
    for f, s in strategies.items():
        every = every & field_match(F.col(f"a.{f}"), F.col(f"e.{f}"), s)
    return aligned.where("status = 'matched'").agg(F.round(F.coalesce(F.avg(every.cast("double")), F.lit(0.0)), 6).alias("exact_match_rate"))


def gate(recall: Column, f1: Column, steps: Column, least_recall: float = 0.8, least_f1: float = 0.7, most_steps: int = 50) -> Column:
    """The reasons why a scenario fails; none if it passes."""
    return F.array_compact(
        F.array(
            F.when(recall < least_recall, F.concat(F.lit("record_recall "), F.format_string("%.3f", F.bround(recall, 3)), F.lit(f" < {least_recall}"))),
            F.when(f1 < least_f1, F.concat(F.lit("field_f1 "), F.format_string("%.3f", F.bround(f1, 3)), F.lit(f" < {least_f1}"))),
            F.when(steps.isNull(), F.lit("steps missing")).when(steps > most_steps, F.concat(F.lit("steps "), steps.cast("string"), F.lit(f" > {most_steps}"))),
        )
    )


def overall(scenarios: DataFrame, reasons: str, f1: str, *efficiency: str) -> DataFrame:
    """Scenarios passed and failed, mean F1, and means of efficiency columns over what is a number."""
    means = [F.round(F.avg(F.col(c).cast("string").try_cast("double")), 4).alias(f"avg_{c}") for c in efficiency]
    return scenarios.agg(F.count_if(F.size(reasons) == 0).alias("passed"), F.count_if(F.size(reasons) > 0).alias("failed"), F.round(F.avg(f1), 4).alias("avg_f1"), *means)


def compare(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    b = before.select(key, *[F.col(v).alias(f"{v}_before") for v in values])
    a = after.select(key, *[F.col(v).alias(f"{v}_after") for v in values])
    return b.join(a, key, "full_outer")


def set_quality(truth: Column, found: Column) -> dict[str, Column]:
    """Precision and recall of a set against another; 0 if either is empty."""
    n = F.size(F.array_intersect(truth, found))
    ok = (F.size(truth) > 0) & (F.size(found) > 0)
    return {"precision": F.when(ok, F.round(n / F.size(F.array_distinct(found)), 6)).otherwise(0.0), "recall": F.when(ok, F.round(n / F.size(F.array_distinct(truth)), 6)).otherwise(0.0)}
