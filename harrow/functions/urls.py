"""Column builders for URL identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, similarity

# Query parameters that number pages, and those that only track a visit.
PAGE_PARAMETERS = ["page", "p", "offset", "start", "pagenum", "pn"]
TRACKING_PARAMETERS = ["spm", "from", "from_source", "fromsite", "source", "sourceid", "session", "sessionid", "sid", "timestamp", "ts"]
TRACKING_PREFIX = "utm_"


def _part(u: Column, pattern: str) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(u, F.lit(""))), pattern, 1)


def scheme(u: Column | str) -> Column:
    return F.lower(_part(c(u), r"^([A-Za-z][A-Za-z0-9+.\-]*):"))


def netloc(u: Column | str) -> Column:
    return F.lower(_part(c(u), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"))


def path(u: Column | str) -> Column:
    return _part(c(u), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)")


def pairs(u: Column | str) -> Column:
    query = _part(c(u), r"^[^?#]*\?([^#]*)")
    return F.filter(F.split(query, "&"), lambda p: p != "")


def key_of(pair: Column) -> Column:
    return F.element_at(F.split(pair, "=", 2), 1)


def value_of(pair: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(pair, "=", 2), F.lit(2)), F.lit(""))


def _rooted(u: Column) -> Column:
    bare = F.regexp_replace(path(u), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def normalise(u: Column | str) -> Column:
    """Lookup form: host without www., path without trailing slashes, query without page numbers and blank values, its keys in order of first use.

    Percent-encoded queries are compared as written.
    """
    url = c(u)
    kept = F.filter(pairs(url), lambda p: (value_of(p) != "") & ~F.lower(key_of(p)).isin(PAGE_PARAMETERS))
    keys = F.array_distinct(F.transform(kept, key_of))
    query = F.array_join(F.flatten(F.transform(keys, lambda k: F.filter(kept, lambda p: key_of(p) == k))), "&")
    base = F.concat(F.regexp_replace(netloc(url), r"^www\.", ""), _rooted(url))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def dedup_form(u: Column | str) -> Column:
    """Dedup form: lower-case scheme and host, sorted query without tracking keys, no fragment."""
    url = c(u)
    key = lambda p: F.lower(F.trim(key_of(p)))
    kept = F.filter(pairs(url), lambda p: ~(key(p).isin(TRACKING_PARAMETERS) | key(p).startswith(TRACKING_PREFIX)))
    order = F.array_sort(F.transform(kept, lambda p: F.struct(key_of(p).alias("k"), value_of(p).alias("v"))))
    query = F.array_join(F.transform(order, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")
    base = F.concat(scheme(url), F.lit("://"), netloc(url), _rooted(url))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def domain(u: Column | str) -> Column:
    return F.regexp_replace(netloc(u), r"^www\.", "")


def host(u: Column | str) -> Column:
    """Without user, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc(u), r"^.*@", ""), r":\d+$", ""), r"\.$", "")


def hash_id(u: Column | str) -> Column:
    return F.substring(F.sha2(c(u).cast("binary"), 256), 1, 16)


def registry_id(url: Column, state: Column, signature: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", url, state, signature).cast("binary")), 1, 16)


def page_parameter(u: Column | str) -> Column:
    """The first parameter that numbers pages."""
    return F.try_element_at(F.filter(F.transform(pairs(u), key_of), lambda k: F.lower(k).isin(PAGE_PARAMETERS)), F.lit(1))


def with_page(u: Column | str, page: Column) -> Column:
    name = page_parameter(u)
    renumbered = F.regexp_replace(c(u), F.concat(F.lit("([?&]"), name, F.lit("=)[^&#]*")), F.concat(F.lit("$1"), page.cast("string")))
    return F.when(name.isNotNull(), renumbered).otherwise(c(u))


def join(base: Column | str, href: Column | str) -> Column:
    """Resolve a link against its page: absolute, scheme-relative, root-relative, query, fragment and relative ones, dots folded."""
    b, h = c(base), F.trim(F.coalesce(c(href), F.lit("")))
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    folder = F.regexp_replace(path(b), "[^/]*$", "")
    tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    raw = F.regexp_extract(h, r"^([^?#]*)", 1)
    whole = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), raw))
    last = F.element_at(F.split(whole, "/"), -1)
    folded = F.aggregate(
        F.split(whole, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    rooted = F.concat(F.array_join(folded, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    bare = F.regexp_replace(b, "#.*$", "")
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("#"), F.concat(bare, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), h))
        .otherwise(F.concat(root, rooted, tail))
    )


def valid(u: Column | str, longest: int = 2048) -> Column:
    v = F.trim(F.coalesce(c(u), F.lit("")))
    return (v != "") & (F.length(v) <= longest) & scheme(v).isin("http", "https") & (netloc(v) != "")


def similar(a: Column | str, b: Column | str) -> Column:
    """1 equal as written, .98 equal in dedup form, .95 equal without scheme, .9 same host and path, else the ratio of the texts."""
    x, y = c(a), c(b)
    bare = lambda u: F.regexp_replace(dedup_form(u), "^[a-z0-9+.-]*://", "")
    place = lambda u: F.concat(netloc(u), _rooted(u))
    return F.when(x == y, 1.0).when(dedup_form(x) == dedup_form(y), 0.98).when(bare(x) == bare(y), 0.95).when((place(x) == place(y)), 0.9).otherwise(similarity(x, y))


def lookup_key(url: Column, state: Column, anchor: Column, variant: Column) -> Column:
    clean = lambda x: F.trim(F.coalesce(x, F.lit("")))
    return F.struct(normalise(url).alias("normalized_url"), clean(state).alias("page_state_signature"), clean(anchor).alias("anchor_url"), clean(variant).alias("variant_label"))
