"""Location paths over a node table: a structural join or window for each step.

A node (key, pos, stop, up) covers the nodes of its key from pos to stop. A child is found by its parent's pos; who lies below or above some
node of a set is seen in one running window over both, in which an interval reaches on until its stop,
so no pairs of nodes are made, however deep the nesting.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut
from .history import latest
from .pages import nodes as parse

URL_ATTRIBUTES = ("href", "src", "data-href")  # fixed values, in this order
AXES = ("child", "descendant", "parent", "ancestor", "self", "following-sibling", "preceding-sibling")
_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
_STEP = re.compile(rf"""(//?)(?:([a-z-]+)::)?(\.\.|\.|\*|[A-Za-z][\w-]*)((?:\[(?:{_QUOTED}|[^\]'"])*\])*)""")
_TEST = re.compile(rf"""(?:(contains|starts-with)\(\s*(@[\w-]+|text\(\)|\.)\s*,\s*({_QUOTED})\s*\)|(@[\w-]+|text\(\)|normalize-space\((?:text\(\)|\.)?\)|\.)(?:\s*=\s*({_QUOTED}))?)""")


def table(pages: DataFrame, key: str, html: str, references: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of each page with what paths need, parsed once: a table in the shared folder. ``references``: as for ``pages.nodes``."""
    return cut(parse(pages, key, html, references).select(key, "pos", "stop", "up", "tag", "text", "attributes"))


@dataclass
class Step:
    axis: str
    tag: str  # * for any
    tests: list[str]  # the predicates, as written


def steps(path: str) -> list[Step]:
    """The steps of one path: /, //, named axes, *, . and .., with predicates; anything else is an error."""
    out, at = [], 0
    path = path.strip()
    for m in _STEP.finditer(path):
        if m.start() != at:
            break
        at, (slash, axis, tag, tests) = m.end(), m.groups()
        axis = axis or {".": "self", "..": "parent"}.get(tag, "child")
        if axis not in AXES or (slash == "//" and axis != "child"):
            raise ValueError(f"axis outside the subset: {m.group()}")
        tests = [t[1:-1].strip() for t in re.findall(rf"""\[(?:{_QUOTED}|[^\]'"])*\]""", tests)]
        out.append(Step("descendant" if slash == "//" else axis, "*" if tag[0] == "." else tag.lower(), tests))
    if not out or at != len(path):
        raise ValueError(f"path outside the subset: {path}")
    return out


def union(xpath: str) -> list[str]:
    return [p for p in re.findall(rf"""(?:{_QUOTED}|[^|'"])+""", xpath) if p.strip()]


def _operand(name: str) -> Column:
    if name[0] == "@":
        return F.try_element_at("attributes", F.lit(name[1:]))
    return F.trim(F.regexp_replace("text", r"\s+", " ")) if name.startswith("normalize") else F.col("text")


def _test(predicate: str) -> Column:
    """A predicate without a position: tests of attributes and text, joined by ``and``."""
    found = F.lit(True)
    for part in re.split(rf"""\s+and\s+(?=(?:{_QUOTED}|[^'"])*$)""", predicate):
        m = _TEST.fullmatch(part.strip())
        if not m:
            raise ValueError(f"predicate outside the subset: {predicate}")
        function, of, text, name, value = m.groups()
        if function:
            found &= F.coalesce((F.contains if function == "contains" else F.startswith)(_operand(of), F.lit(text[1:-1])), F.lit(False))
        elif value:
            found &= F.coalesce(_operand(name) == value[1:-1], F.lit(False))
        else:
            found &= F.coalesce(_operand(name), F.lit("")) != "" if name[0] != "@" else _operand(name).isNotNull()
    return found


def _running(order: list[Column], key: str) -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _covered(nodes: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """The nodes below some node of the context: an interval that began before reaches them."""
    both = nodes.withColumn("reach", F.lit(None).cast("int")).unionByName(context.select(key, "pos", F.col("stop").alias("reach")), allowMissingColumns=True)
    reach = F.max("reach").over(_running([F.col("pos"), F.col("reach").isNotNull()], key))
    return both.withColumn("covered", reach).where(F.col("reach").isNull() & (F.col("covered") >= F.col("pos"))).drop("reach", "covered")


def _covering(nodes: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """The nodes above some node of the context: the next one after them comes before their stop."""
    both = nodes.withColumn("next", F.lit(None).cast("int")).unionByName(context.select(key, "pos", F.col("pos").alias("next")), allowMissingColumns=True)
    following = F.min("next").over(_running([F.desc("pos"), F.col("next").isNotNull()], key))
    return both.withColumn("below", following).where(F.col("next").isNull() & (F.col("below") <= F.col("stop"))).drop("next", "below")


def _axis(nodes: DataFrame, context: DataFrame | None, step: Step, key: str) -> DataFrame:
    if context is None:  # from the document
        if step.axis == "descendant":
            return nodes
        return nodes.where("up = -1") if step.axis == "child" else nodes.limit(0)
    if step.axis == "child":
        return nodes.join(context.select(key, F.col("pos").alias("up")), [key, "up"], "left_semi")
    if step.axis == "descendant":
        return _covered(nodes, context, key)
    if step.axis == "ancestor":
        return _covering(nodes, context, key)
    if step.axis in ("self", "parent"):
        own = context.select(key, F.col("pos" if step.axis == "self" else "up").alias("pos"))
        return nodes.join(own, [key, "pos"], "left_semi")
    after = step.axis == "following-sibling"
    edge = context.groupBy(key, "up").agg((F.min if after else F.max)("pos").alias("edge"))
    near = nodes.join(edge, [key, "up"])
    return near.where(F.col("pos") > F.col("edge") if after else F.col("pos") < F.col("edge")).drop("edge")


def select(nodes: DataFrame, key: str, path: str) -> DataFrame:
    """The nodes on one path. A position counts the children of one parent that passed the tests before it."""
    own = None
    for step in steps(path):
        wanted = nodes if step.tag == "*" else nodes.where(F.col("tag") == step.tag)
        own = _axis(wanted, own, step, key)
        for test in step.tests:
            if not test.isdigit() and test != "last()":
                own = own.where(_test(test))
                continue
            if step.axis not in ("child", "descendant"):
                raise ValueError(f"a position on the axis {step.axis} is outside the subset")
            place = Window.partitionBy(key, "up").orderBy("pos" if test.isdigit() else F.desc("pos"))
            own = own.withColumn("__n", F.row_number().over(place)).where(F.col("__n") == (int(test) if test.isdigit() else 1)).drop("__n")
    return own


def node_value(kind: str = "text") -> Column:
    """The value of a node: for kind url its first attribute that is a URL, else its text; trimmed."""
    attributes = [F.nullif(F.trim(F.try_element_at("attributes", F.lit(a))), F.lit("")) for a in URL_ATTRIBUTES] if kind == "url" else []
    return F.coalesce(*attributes, F.trim("text"))


def evaluate(nodes: DataFrame, key: str, xpath: str, kind: str = "text") -> DataFrame:
    """All nodes of each key on a path or a union of paths, once each, with the value of each."""
    found = None
    for path in union(xpath):
        own = select(nodes, key, path)
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise ValueError("a path is needed")
    once = found if len(union(xpath)) == 1 else found.dropDuplicates([key, "pos"])
    return once.withColumn("value", node_value(kind))


def samples(found: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Of the first ``most`` nodes of each key those whose value is not blank."""
    return latest(found, [key], [F.col("pos")], most).where("value <> ''")


def verified(found: DataFrame, by: list[str], expected: Column, kind: Column, suspicious: Column | None = None, most: int = 20, sampled: int = 6) -> DataFrame:
    """by, matches, value, ok: whether a path holds on a page.

    It must match 1 to ``most`` nodes; of the first ``sampled`` those whose value equals the expected one, or shares a long
    prefix with it (all that are not blank if none is expected), must have one normalised value, of the field's kind, and none may be ``suspicious``.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    value, wanted = F.trim(F.coalesce("value", F.lit(""))), T.normalise(F.coalesce(expected, F.lit("")))
    fits = (value != "") & ((wanted == "") | T.strict_match(value, expected) | T.prefix_match(value, expected))
    marked = found.select(*by, "pos", "tag", value.alias("value"), expected.alias("expected"), kind.alias("kind"), fits.alias("fits"), place.alias("place"), (F.lit(False) if suspicious is None else suspicious).alias("suspicious"))
    own = F.col("fits") & (F.col("place") <= sampled)
    out = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct(F.when(own, T.normalise("value"))).alias("different"),
        F.min_by(F.when(own, F.col("value")), F.when(own, F.col("pos"))).alias("value"),
        F.coalesce(F.bool_or(F.col("suspicious") & (F.col("place") <= sampled)), F.lit(False)).alias("odd"),
        F.first("kind").alias("kind"),
    )
    ok = F.col("matches").between(1, most) & (F.col("different") == 1) & T.semantic_type_ok("value", F.col("kind")) & ~F.col("odd")
    return out.select(*by, "matches", F.when(ok, F.col("value")).alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))
