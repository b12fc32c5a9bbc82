"""Column builders for text, numbers and lenient values."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

SPACE = r"[\s ]+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(F.trim(c(x)), F.lit(""))


def is_blank(x: Column | str) -> Column:
    """NULL and '' are the same in identity rules."""
    return F.coalesce(c(x), F.lit("")) == ""


def normalise(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c(x), SPACE, " ")))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", re.sub("[\u200b-\u200d\ufeff]", "", unicodedata.normalize("NFKC", t))).strip().casefold())


def normalise_loose(x: Column | str) -> Column:
    """Compatibility forms, case and white space folded, zero-width characters dropped. Plain ASCII stays in the JVM."""
    v = c(x)
    plain = v.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(F.trim(F.regexp_replace(v, SPACE, " ")))).otherwise(_folded(F.when(~plain, v)))


def no_space(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(c(x), SPACE, ""))


def compact(x: Column | str, most: int = 60) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(c(x), F.lit("")), SPACE, " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def strict_match(source: Column | str, target: Column | str) -> Column:
    """Equal after normalising, or target stands between word boundaries, or is contained when white space is dropped."""
    a, b = normalise(source), normalise(target)
    quoted = F.regexp_replace(b, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    ascii_word = b.rlike(r"^[\x00-\x7F]+$")
    bounded = F.regexp_like(a, F.concat(F.lit(r"(?<![a-z0-9])"), quoted, F.lit(r"(?![a-z0-9])")))
    return (b != "") & ((a == b) | F.when(ascii_word, bounded).otherwise(F.contains(no_space(source), no_space(target))))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix without white space and case."""
    x, y = F.split(no_space(a), ""), F.split(no_space(b), "")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & (p != ""))
    first = F.array_position(same, False)
    return F.when((no_space(a) == "") | (no_space(b) == ""), 0).when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def prefix_match(a: Column | str, b: Column | str, least: int = 8, share: float = 0.4) -> Column:
    return common_prefix(a, b) >= F.greatest(F.lit(least), F.ceil(F.length(no_space(b)) * share))


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """1 if equal, 0.95 if one contains the other, else the matching-blocks ratio. The
    ratio needs Python; the cases before it are settled natively and give it empty strings.
    So do pairs whose lengths, 2 * min / (a + b), bound the ratio below ``least``: they are 0."""
    x, y = normalise(a), normalise(b)
    short = 2 * F.least(F.length(x), F.length(y)) < least * (F.length(x) + F.length(y))
    settled = (x == "") | (y == "") | (x == y) | F.contains(x, y) | F.contains(y, x)
    rest = _ratio(F.when(settled | short, "").otherwise(x), F.when(settled | short, "").otherwise(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(settled, 0.95).when(short, 0.0).otherwise(rest)


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rate_text(success: Column, total: Column) -> Column:
    share = F.bround(100 * safe_divide(success, total), 0).cast("int")
    return F.concat(share.cast("string"), F.lit("% ("), success.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))


def positive_int(x: Column | str) -> Column:
    n = F.trim(c(x)).try_cast("int")
    return F.when(n > 0, n)


def as_bool(x: Column | str, default: Column | None = None) -> Column:
    """true, yes, on, 1 and their opposites in any case; else the default."""
    low = F.lower(F.trim(c(x).cast("string")))
    return F.when(low.isin("true", "1", "yes", "y", "on"), True).when(low.isin("false", "0", "no", "n", "off"), False).otherwise(F.lit(None).cast("boolean") if default is None else default)


def as_number(x: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c(x).cast("string")).try_cast("double"), F.lit(default))


def string_list(x: Column) -> Column:
    """The trimmed entries of an array that are not blank, in order; an empty array for null."""
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")


def first_map(*candidates: Column) -> Column:
    """The first map that has an entry."""
    return F.coalesce(*[F.when(F.size(m) > 0, m) for m in candidates])


def labels(x: Column) -> Column:
    """Sorted different trimmed labels, in code point order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != "")))


def string_map(m: Column) -> Column:
    return F.map_filter(F.transform_values(m, lambda _, v: F.trim(v)), lambda _, v: F.coalesce(v, F.lit("")) != "")


def semantic_type_ok(value: Column | str, kind: Column, longest: int | None = None) -> Column:
    """url, number or date by form; other kinds by length. Blank is never valid."""
    v, k = F.trim(F.coalesce(c(value), F.lit(""))), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    url = v.startswith("/") | v.rlike(r"^(?i:https?)://[^/?#]+")
    head, core = F.regexp_extract(v, r"^\D*", 0), F.regexp_extract(v, r"\d(?:.*\d)?", 0)
    signs = F.substring(head, F.lit(1), F.length(head) - 1)  # a sign may stand right before the first digit only
    number = (core != "") & (F.regexp_replace(core, r"[\d,.\s]", "") == "") & (F.translate(signs, "+-", "") == signs)
    date = v.rlike(r"\d[-/]\d") | v.rlike(r"\d{4}年\d")
    other = F.lit(True) if longest is None else F.length(v) <= longest
    return (v != "") & F.when(k == "url", url).when(k == "number", number).when(k == "date", date).otherwise(other)


def safe_filename(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(c(x)), r'[<>:"/\\|?*\x00-\x1f]', "_")


def chat_urls(text: Column | str) -> Column:
    """The different URLs of a text in order of appearance, without trailing punctuation."""
    found = F.regexp_extract_all(c(text), F.lit(r"(https?://[^\s<>\"']+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")), lambda u: u.rlike(r"^https?://[^/?#]+")))


def joined_reason(errors: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.filter(errors, lambda e: F.trim(e) != ""), "; "), F.lit("")), F.lit(default))


def preview(names: Column, most: int = 3) -> Column:
    head = F.array_join(F.slice(names, 1, most), "、")
    return F.when(F.size(names) > most, F.concat(head, F.lit("等"))).otherwise(head)


def name_match(reported: Column | str, expected: Column | str) -> Column:
    a, b = F.lower(F.trim(F.coalesce(c(reported), F.lit("")))), F.lower(F.trim(F.coalesce(c(expected), F.lit(""))))
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def keywords_present(html: Column | str, words: Column) -> Column:
    """Any of the words in the text of a page, without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c(html)), r"(?s)<script.*?</script>", " "), r"(?s)<style.*?</style>", " "), r"<[^>]+>", " ")
    return F.exists(words, lambda w: (w != "") & F.contains(bare, F.lower(w)))


def index_list(values: Column, available: Column, most: int) -> Column:
    """Whole numbers in range, each once, 0 taken as 1, at most ``most``."""
    numbers = F.transform(F.transform(values, lambda v: F.trim(v).try_cast("int")), lambda n: F.when(n == 0, 1).otherwise(n))
    return F.slice(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= available))), 1, most)


def variants(x: Column | str) -> Column:
    """Forms of a quoted text: as it is, without an ellipsis, without brackets at its end, its part before them."""
    v = F.trim(F.coalesce(c(x), F.lit("")))
    forms = F.array(v, F.trim(F.regexp_replace(v, r"(\.{2,}|…)+$", "")), F.trim(F.regexp_replace(v, r"\s*[\[(（【][^\])）】]*[\])）】]?$", "")), F.trim(F.regexp_extract(v, r"^(.*?)(?:\.{3}|…)", 1)))
    return F.array_distinct(F.filter(forms, lambda s: s != ""))


def _salvage(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    decoder = json.JSONDecoder()

    def first(t: str | None) -> str | None:
        body = re.sub(r",\s*([}\]])", r"\1", (t or "").translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"}))
        for at in (m.start() for m in re.finditer(r"\{", body)):
            try:
                found, _ = decoder.raw_decode(body, at)
            except ValueError:
                continue
            return json.dumps(found, ensure_ascii=False)
        return None

    for column in texts:
        yield pd.Series([first(t) for t in column], dtype=object)


def json_object_in(x: Column | str) -> Column:
    """The first JSON object in a text, fences, typographic quotes and trailing commas forgiven; read it with from_json."""
    return F.pandas_udf(_salvage, StringType())(c(x))


def render(template: Column | str, values: Column) -> Column:
    """A text with {{name}} replaced by the values of a map; blanks inside the braces are allowed, unknown names stay."""
    at = F.map_entries(values)
    fill = lambda text, e: F.regexp_replace(text, F.concat(F.lit(r"\{\{\s*\Q"), e["key"], F.lit(r"\E\s*\}\}")), F.regexp_replace(F.coalesce(e["value"], F.lit("")), r"([\\$])", r"\\$1"))
    return F.aggregate(at, c(template), fill)


# Roles without a line of their own, and those that show their state.
SILENT_ROLES = {"none", "presentation", "generic", "separator", "group"}
STATE_ROLES = {"tab", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "checkbox", "switch", "treeitem"}


def _outline(texts: Iterator[pd.Series], deepest: int, most: int) -> Iterator[pd.Series]:
    def line(node: dict, role: str, name: str) -> str:
        parts = [role] if role and role != "text" else []
        if name:
            parts.append('"' + (name if len(name) <= 200 else name[:197] + "...") + '"')
        if role in STATE_ROLES:
            opened = {True: "expanded", False: "collapsed"}.get(node.get("expanded")) if isinstance(node.get("expanded"), bool) else None
            flags = ["selected" if node.get("selected") else None, opened, *(k if node.get(k) in (True, "true") else None for k in ("checked", "pressed"))]
            if any(flags):
                parts.append(f"[{', '.join(f for f in flags if f)}]")
        return " ".join([*parts, *(["[disabled]"] if node.get("disabled") else [])])

    def lines(text: str | None) -> list[str] | None:
        try:
            todo = [(json.loads(text or ""), 0)]
        except ValueError:
            return None
        out: list[str] = []
        while todo and len(out) < most:
            node, depth = todo.pop()
            if not isinstance(node, dict) or depth > deepest:
                continue
            role, name = str(node.get("role") or "").strip().lower(), str(node.get("name") or "").strip()
            silent = role in SILENT_ROLES or not (role or name)
            if not silent and (own := line(node, role, name)):
                out.append("  " * depth + own)
            todo += [(child, depth + (not silent)) for child in reversed(node.get("children") or [])]
        return out

    for column in texts:
        yield column.map(lines)


def outline(tree: Column | str, deepest: int = 20, most: int = 500) -> Column:
    """An accessibility tree (JSON) as indented lines, depth first: at most ``most`` of them, as the tree's reader takes; null for no JSON.
    Roles without meaning have no line, their children stand in their place."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _outline(texts, deepest, most)

    return F.pandas_udf(run, "array<string>")(c(tree))
