"""HTML pages as tables of nodes.

One small parser turns a page into rows of nodes; search, links and paths
are DataFrame operations on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..functions import urls
from .history import latest

# Fixed values of HTML: elements without an end tag, and those whose text is no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}
NODE = "pos int, stop int, up int, level int, tag string, path string, marked string, text string, attributes map<string,string>"
KEY = "__page"
_ARROW = pa.schema([(n, pa.int32()) for n in ("pos", "stop", "up", "level")] + [(n, pa.string()) for n in ("tag", "path", "marked", "text")] + [("attributes", pa.map_(pa.string(), pa.string()))])


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, path, marked path, children by tag, row
        self.rows: list[dict] = []
        self.roots: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        up = self.open[-1] if self.open else ["", "", "", self.roots, None]
        up[3][tag] = n = up[3].get(tag, 0) + 1
        own = {k: v or "" for k, v in attrs}
        safe = lambda v: re.sub(r"[/{}]", "_", v)
        marks = "".join(f"{{{k}={safe(own[k])}}}" for k in ("id", "class") if k in own)
        row = {"pos": len(self.rows), "tag": tag, "path": f"{up[1]}/{tag}[{n}]", "marked": f"{up[2]}/{tag}[{n}]{marks}", "text": "", "attributes": own}
        row |= {"up": up[4]["pos"] if up[4] else -1, "level": len(self.open), "stop": row["pos"]}
        self.rows.append(row)
        if tag not in VOID:
            self.open.append([tag, row["path"], row["marked"], {}, row])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and tag not in VOID:
            self.leave()

    def leave(self) -> str:
        """Close the innermost element: what came since it began lies in it."""
        tag, *_, row = self.open.pop()
        row["stop"] = len(self.rows) - 1
        return tag

    def handle_endtag(self, tag: str) -> None:
        if any(o[0] == tag for o in self.open):
            while self.leave() != tag:
                pass

    def close(self) -> None:
        super().close()
        while self.open:
            self.leave()

    def handle_data(self, data: str) -> None:
        if self.open and not any(o[0] in HIDDEN for o in self.open):
            self.open[-1][4]["text"] += data


MOST_NODES, MOST_CHARS = 4096, 4_000_000  # of one batch of rows: a worker holds no more of its results than these

_REFERENCE = re.compile(r"&(?:([A-Za-z][A-Za-z0-9]*);)?")


def only_references(html: str, names: frozenset[str]) -> str:
    """The page with the ampersand written out of all that looks like a reference, but for those of these names with their semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in names else f"&amp;{m[0][1:]}", html)


def _parser(fields: pa.Schema, references: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def table(keys: pa.Array, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        own = [pa.array([list(r[f.name].items()) if f.name == "attributes" else r[f.name] for r in rows], f.type) for f in fields]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *own], schema=fields.insert(0, pa.field(KEY, keys.type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, rows, chars = batch.column(0), [], [], 0
            for i, html in enumerate(batch.column(1)):
                p, text = _Nodes(), html.as_py() or ""
                p.feed(text if references is None else only_references(text, references))
                p.close()
                for row in p.rows:
                    at.append(i)
                    rows.append(row)
                    chars += len(row["path"]) + len(row["marked"]) + len(row["text"]) + sum(len(k) + len(v) for k, v in row["attributes"].items())
                    if len(rows) >= MOST_NODES or chars >= MOST_CHARS:
                        yield table(keys, at, rows)
                        at, rows, chars = [], [], 0
            if rows:
                yield table(keys, at, rows)

    return run


def nodes(pages: DataFrame, key: str, html: str, references: Iterable[str] | None = None) -> DataFrame:
    """A row for each element: key, pos, stop (pos of the last element in it), up (pos of its parent, -1 for none), level, tag, path, marked (path with ids and classes), text, attributes.

    Character references are decoded as in HTML, some of them without their semicolon too ("&amp" at the end of a title);
    with ``references`` only those of these names that have their semicolon, and all else stays as written.
    A worker hands its rows on in batches of bounded size, so what it holds doesn't grow with the pages of its task.
    """
    own = StructType([StructField(KEY, pages.schema[key].dataType), *StructType.fromDDL(NODE)])
    found = pages.select(F.col(key).alias(KEY), F.col(html).alias("html")).mapInArrow(_parser(_ARROW, None if references is None else frozenset(references)), own)
    return found.withColumnRenamed(KEY, key)


def links(found: DataFrame, pages: DataFrame, key: str, url: str) -> DataFrame:
    """Absolute targets of links with their paths."""
    a = found.where((F.col("tag") == "a") & (F.coalesce(F.try_element_at("attributes", F.lit("href")), F.lit("")) != ""))
    return a.join(pages.select(key, F.col(url).alias("__base")), key).select(key, "pos", "path", urls.join("__base", F.element_at("attributes", F.lit("href"))).alias("target"), F.trim("text").alias("text"))


_MARKS = r"(?:\{[^}]*\})*"


def _predicate(p: str) -> tuple[str, str]:
    """A predicate of the subset as (index or '', mark or '')."""
    name, sign, value = (x.strip() for x in p.removesuffix(")").removeprefix("contains(").partition("," if p.startswith("contains(") else "="))
    if p.isdigit():
        return rf"\[{p}\]", ""
    if name not in ("@id", "@class") or not sign or len(value) < 2 or value[0] not in "'\"" or value[-1] != value[0]:
        raise ValueError(f"predicate outside the subset: {p}")
    loose = "[^}]*" if p.startswith("contains(") else ""
    return "", rf"{_MARKS}\{{{name[1:]}={loose}{re.escape(value[1:-1])}{loose}\}}{_MARKS}"


def step_regex(xpath: str) -> str:
    """A path of the subset (/, //, *, [n], [@id='x'], [contains(@class,'x')], union) as a pattern over marked paths."""
    paths = []
    for one in xpath.split("|"):
        out, deep = "", False
        for part in re.split(r"/(?![^\[\]]*\])", one.strip())[1:]:
            if not part:
                deep = True
                continue
            tag, *predicates = (x.rstrip("] ").strip() for x in part.split("["))
            index, marks = r"\[\d+\]", _MARKS
            for p in predicates:
                at, mark = _predicate(p)
                index, marks = at or index, mark or marks
            out += ("(?:/[^/]+)*/" if deep else "/") + (r"[\w-]+" if tag == "*" else re.escape(tag)) + index + marks
            deep = False
        paths.append(out)
    return "^(?:" + "|".join(paths) + ")$"


def evaluate(found: DataFrame, key: str, xpath: str, kind: str = "text", most: int = 8) -> DataFrame:
    """The first ``most`` nodes of each page on a path, with the value of each: a URL attribute for kind url, else its text."""
    value = F.trim("text")
    if kind == "url":
        value = F.coalesce(*[F.try_element_at("attributes", F.lit(a)) for a in ("href", "src", "data-href")], value)
    return latest(found.where(F.col("marked").rlike(step_regex(xpath))).withColumn("value", value), [key], [F.col("pos")], most)


def search(found: DataFrame, target: Column, how: str = "strict", threshold: float = 0.8) -> DataFrame:
    """Nodes whose text matches: strict, prefix, or fuzzy with its similarity; ``ranks`` orders those of a page.

    Fuzzy compares only texts whose length allows a ratio of ``threshold``.
    """
    texts = found.where(F.trim("text") != "")
    if how == "strict":
        return texts.where(T.strict_match("text", target))
    if how == "prefix":
        return texts.where(T.prefix_match("text", target))
    return texts.withColumn("similarity", T.similarity(F.col("text"), target, threshold)).where(F.col("similarity") >= threshold)


def ranks(matches: DataFrame, key: str, fuzzy: bool = False) -> DataFrame:
    """The place of each match on its page: the most similar first for fuzzy matches, else by position, longer texts first."""
    order = [F.col("similarity").desc(), F.col("pos")] if fuzzy else [F.col("pos"), F.length("text").desc()]
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def search_url(found: DataFrame, target: Column, threshold: float = 0.7) -> DataFrame:
    """Nodes with a URL attribute that is similar to the target."""
    attribute = F.explode(F.filter(F.map_entries("attributes"), lambda e: e["key"].isin("href", "src", "data-href", "content"))).alias("a")
    near = found.select("*", attribute).withColumn("similarity", urls.similar(F.col("a.value"), target))
    return near.where(F.col("similarity") >= threshold).select("*", F.col("a.key").alias("attribute"), F.col("a.value").alias("value")).drop("a")


def xpath_candidates(found: DataFrame) -> DataFrame:
    """Paths for a node by strategy and priority: id, test id, class anchor, path below an id, data attribute, absolute path."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    stable_id = F.when((at("id") != "") & ~at("id").rlike(r"\d{4,}|[0-9a-f]{8,}"), at("id"))
    word = F.get(F.filter(F.split(F.coalesce(at("class"), F.lit("")), r"\s+"), lambda w: (w != "") & ~w.rlike(r"\d{3,}|^(active|hover|selected|open)$")), F.lit(0))
    above = F.regexp_extract("marked", r"^.*\{id=([^}]*)\}[^/]*(?:/[^{]*)$", 1)
    below = F.regexp_replace(F.regexp_extract("marked", r"^.*\{id=[^}]*\}[^/]*(/[^{]*)$", 1), r"\{[^}]*\}", "")
    data = F.get(F.filter(F.map_entries("attributes"), lambda e: e["key"].startswith("data-") & (e["key"] != "data-testid")), F.lit(0))
    make = [
        ("id", F.concat(F.lit("//*[@id='"), stable_id, F.lit("']"))),
        ("testid", F.concat(F.lit("//*[@data-testid='"), at("data-testid"), F.lit("']"))),
        ("class-anchor", F.concat(F.lit("//"), F.col("tag"), F.lit("[contains(@class,'"), word, F.lit("')]"))),
        ("id-relative", F.when((above != "") & (below != ""), F.concat(F.lit("//*[@id='"), above, F.lit("']"), below))),
        ("data-attr", F.concat(F.lit("//"), F.col("tag"), F.lit("[@"), data["key"], F.lit("='"), data["value"], F.lit("']"))),
        ("absolute", F.col("path")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(s).alias("strategy"), x.alias("xpath")) for i, (s, x) in enumerate(make)])
    return found.select("*", F.explode(F.filter(rows, lambda r: r["xpath"].isNotNull())).alias("c")).select("*", "c.*").drop("c")


def first_success(values: DataFrame, key: str, chain_pos: str, xpath: str, value: str, kind: Column) -> DataFrame:
    """Along a chain of paths: the first that has exactly one valid value."""
    tried = values.groupBy(key, chain_pos, xpath).agg(F.count("*").alias("matches"), F.count_distinct(T.normalise(value)).alias("different"), F.min(value).alias("value"), F.bool_and(T.semantic_type_ok(value, kind)).alias("ok"))
    good = (F.col("different") == 1) & F.col("ok") & F.col("matches").between(1, 20)
    return tried.groupBy(key).agg(F.min(F.when(good, F.struct(chain_pos, xpath, "value"))).alias("m"), F.count("*").alias("attempts")).select(key, F.col(f"m.{xpath}").alias(xpath), F.col("m.value").alias("value"), "attempts")
