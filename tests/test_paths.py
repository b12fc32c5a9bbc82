"""Paths by structural joins against a walk over the tree of each page."""

import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.operators import pages, paths

PATHS = [
    "/html/body", "/div", "//a", "//div/a", "//div//a", "//div//div", "//*[@id='x1']", "//*[@id]/*", "//a[2]", "//div[1]/p[last()]", "//p/..", "//a/ancestor::div", "//a/ancestor::*", "//p/following-sibling::a", "//a/preceding-sibling::*",
    "//a[@class='c1'][1]", "//a[1][@class='c1']", "//div[contains(@class,'c')]//p", "//p[contains(text(),'t1')]", "//p[starts-with(@class,'c') and @id]", "//p[.='t2']", "//a[normalize-space()='t 1']", "//div/self::div", "//div/./p", "//div/descendant::a", "//div/child::p[2]",
    "//a | //p", "//a | //a[1] | /html", "//*[@class=\"a|b\"]", "//div/parent::div", "//body//div[2]//p[1]",
]


class Node:
    def __init__(self, tag, up, attributes):
        self.tag, self.up, self.attributes, self.children, self.text = tag, up, attributes, [], ""


def page(rng):
    def grow(up, depth):
        for _ in range(rng.randrange(4)):
            own = {k: v for k, v in (("id", f"x{rng.randrange(3)}"), ("class", rng.choice(["c1", "c2", "a|b", "d"]))) if rng.random() < 0.4}
            n = Node(rng.choice(["div", "a", "p"]), up, own)
            n.text = rng.choice(["", "t1", "t2", " t  1 "])
            up.children.append(n)
            if depth < 5:
                grow(n, depth + 1)

    html = Node("html", None, {})
    body = Node("body", html, {})
    html.children.append(body)
    grow(body, 0)
    write = lambda n: f"<{n.tag}{''.join(f' {k}="{v}"' for k, v in n.attributes.items())}>{n.text}{''.join(map(write, n.children))}</{n.tag}>"
    order = []

    def number(n):
        n.pos = len(order)
        order.append(n)
        for c in n.children:
            number(c)

    number(html)
    return write(html), order


def below(n):
    for c in n.children:
        yield c
        yield from below(c)


def holds(n, test):
    for part in test.split(" and "):
        name = re.search(r"@([\w-]+)", part)
        of = n.attributes.get(name[1]) if name else n.text
        value = re.search(r"""["'](.*)["']""", part)
        if "normalize" in part:
            of = " ".join(n.text.split())
        if value is None:
            ok = of is not None
        elif part.startswith("contains"):
            ok = of is not None and value[1] in of
        elif part.startswith("starts-with"):
            ok = of is not None and of.startswith(value[1])
        else:
            ok = of == value[1]
        if not ok:
            return False
    return True


def walk(order, path):
    """Straight from the meaning of each axis, one context node at a time."""
    context = [None]
    for slash, axis, tag, tests in re.findall(r"""(//?)(?:([a-z-]+)::)?(\.\.|\.|\*|\w+)((?:\[[^\]]*\])*)""", path.strip()):
        found = []
        axis = axis or {".": "self", "..": "parent"}.get(tag, "child")
        for c in context:
            groups = []
            if slash == "//":
                groups = [p.children for p in ([c, *below(c)] if c else order)] + ([[order[0]]] if c is None else [])
            elif axis == "child":
                groups = [c.children if c else [order[0]]]
            elif c:
                side = c.up.children if c.up else [c]
                groups = {"descendant": [p.children for p in [c, *below(c)]], "parent": [[c.up]] if c.up else [], "self": [[c]], "following-sibling": [side[side.index(c) + 1 :]], "preceding-sibling": [side[: side.index(c)]]}.get(axis)
                if axis == "ancestor":
                    groups, up = [], c.up
                    while up:
                        groups.append([up])
                        up = up.up
            for g in groups:
                g = [n for n in g if tag in ("*", ".", "..") or n.tag == tag]
                for t in re.findall(r"\[([^\]]*)\]", tests):
                    g = g[int(t) - 1 : int(t)] if t.isdigit() else g[-1:] if t == "last()" else [n for n in g if holds(n, t)]
                found += g
        context = list({id(n): n for n in found}.values())
    return {n.pos for n in context}


def test_paths_as_a_walk(spark):
    rng = random.Random(4)
    made = [page(rng) for _ in range(12)]
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(made)], "page long, html string")
    nodes = pages.nodes(df, "page", "html").persist()
    assert {(r.page, r.pos): r.up for r in nodes.collect()} == {(i, n.pos): n.up.pos if n.up else -1 for i, (_, order) in enumerate(made) for n in order}
    found = None
    for path in PATHS:
        own = paths.evaluate(nodes, "page", path).select(F.lit(path).alias("path"), "page", "pos")
        found = own if found is None else found.unionByName(own)
    got = {}
    for r in found.collect():
        got.setdefault((r.path, r.page), []).append(r.pos)
    for path in PATHS:
        for i, (_, order) in enumerate(made):
            want = set().union(*[walk(order, p) for p in ([path] if '"' in path else path.split("|"))])
            assert sorted(got.get((path, i), [])) == sorted(want), path
    nodes.unpersist()


def test_outside_the_subset():
    for path in ("a", "", "//", "//a[position()<3]", "/following::a", "//a[2", "//a[@x=1]", "//following-sibling::a"):
        with pytest.raises(ValueError):
            [paths._test(t) for s in paths.steps(path) for t in s.tests if not t.isdigit()]


def test_verified(spark):
    value = lambda rule, *own: [(rule, i, "a" if v != "btn" else "button", v) for i, v in enumerate(own)]
    rows = [
        *value("one", "Price list of 2024", "other", ""), *value("prefix", "Price list of 2024 and more text", "x"), *value("two", "Price list of 2024", "price list of  2024 (b)"),
        *value("none", "x", "y"), *value("late", "a", "b", "c", "d", "e", "f", "Price list of 2024"), *value("wide", *["Price list of 2024"] * 21), *value("same", *["Price list of 2024"] * 20), *value("odd", "Price list of 2024", "btn"), *value("blank", "", " "),
    ]
    df = spark.createDataFrame(rows, "rule string, pos int, tag string, value string")
    out = {r.rule: (r.matches, r.value, r.ok) for r in paths.verified(df, ["rule"], F.lit("Price list of 2024"), F.lit("text"), F.col("tag") == "button").collect()}
    assert {k for k, v in out.items() if v[2]} == {"one", "prefix", "same"}
    assert out["one"] == (3, "Price list of 2024", True) and out["wide"] == (21, None, False) and out["two"][1] is None
    any_value = {r.rule: r.ok for r in paths.verified(df.where("rule in ('none', 'same', 'blank')"), ["rule"], F.lit(None).cast("string"), F.lit("text")).collect()}
    assert any_value == {"none": False, "same": True, "blank": False}


def test_samples_and_values(spark):
    df = spark.createDataFrame([(1, "<a href=' /u '>t</a><a href=''> s </a><img src='i.png'><p></p><p>x</p>")], "page long, html string")
    nodes = pages.nodes(df, "page", "html")
    assert [r.value for r in paths.evaluate(nodes, "page", "//*", "url").orderBy("pos").collect()] == ["/u", "s", "i.png", "", "x"]
    assert [r.value for r in paths.samples(paths.evaluate(nodes, "page", "//*"), "page", 5).orderBy("pos").collect()] == ["t", "s", "x"]
