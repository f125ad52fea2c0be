"""Addresses as Column expressions: parts, filters, joins. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments of pages without content, query parameters that filter, and those that page.
NON_CONTENT_SEGMENTS = ["new", "create", "edit", "update", "delete", "destroy", "admin", "sign_in", "sign_up", "login", "logout", "register", "password", "account", "profile", "settings"]
FILTER_PARAMS = [
    "sort", "sort_by", "order", "order_by", "orderby", "direction", "category", "cat", "type", "format", "topic", "subject", "theme",
    "tag", "tags", "keyword", "keywords", "audience", "level", "difficulty", "target", "language", "lang", "locale",
    "status", "date", "from", "to", "year", "month", "q", "query", "search", "s", "view", "display",
]
PAGINATION_PARAMS = ["page", "p", "pg", "offset", "start", "skip", "cursor", "after", "before"]

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    """The path without the parameters (;x) of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return _part(url, 4)


def parameter_names(url: Column) -> Column:
    """The distinct names of the query's parameters, decoded, in lower case; blanks count, repeats don't."""
    pieces = F.filter(F.split(query(url), "&"), lambda t: t != "")
    raw = F.transform(pieces, lambda t: F.translate(F.split_part(t, F.lit("="), F.lit(1)), "+", " "))
    return F.array_distinct(F.transform(raw, lambda t: F.lower(F.coalesce(F.try_url_decode(t), t))))


def is_non_content(url: Column) -> Column:
    """Whether a segment of the path says that the page holds no content (forms, accounts, administration)."""
    return F.arrays_overlap(F.split(F.lower(path(url)), "/"), F.array(*map(F.lit, NON_CONTENT_SEGMENTS)))


def is_faceted(url: Column, source: Column) -> Column:
    """Whether a link only narrows the listing it stands on: same path, and filter parameters but no others."""
    names = parameter_names(url)
    same = F.rtrim(path(url), F.lit("/")) == F.rtrim(path(source), F.lit("/"))
    filters, pages = F.array(*map(F.lit, FILTER_PARAMS)), F.array(*map(F.lit, PAGINATION_PARAMS))
    return same & (F.size(names) > 0) & ~F.arrays_overlap(names, pages) & (F.size(F.array_except(names, filters)) == 0)


def is_navigable(href: Column) -> Column:
    """Whether a link leads to a page: no fragment, mail, script or other scheme than http(s)."""
    h = F.trim(href)
    return (h != "") & ~h.startswith("#") & ((scheme(h) == "") | scheme(h).isin("http", "https"))


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved; what leads above the root is dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    start = F.slice(parts, 1, 0)
    kept = F.reduce(parts, start, lambda out, p: F.when(p == ".", out).when(p == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(p))))
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(closed, "/")).otherwise(path)


def absolute(href: Column, base: Column) -> Column:
    """A link made absolute: absolute, scheme-relative, root-relative, query-only, path-relative and empty links, dot segments resolved."""
    origin = F.concat(_part(base, 1), F.lit("://"), host(base))
    folder = F.regexp_replace(_part(base, 3), r"[^/]*$", "")
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    bare = F.regexp_extract(href, r"^([^?#]*)", 1)
    return (
        F.when(scheme(href) != "", href)
        .when(href == "", F.regexp_replace(base, r"#.*$", ""))
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(bare), tail))
        .when(href.startswith("?"), F.concat(origin, _part(base, 3), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), bare)), tail))
    )


def directory_name(url: Column) -> Column:
    """A short name for files: without scheme, everything but letters, digits, `_` and `-` as single underscores, at most 80 characters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https://", ""), r"^http://", "")
    safe = F.regexp_replace(F.regexp_replace(bare, r"[^a-zA-Z0-9_-]", "_"), r"_+", "_")
    return F.left(F.btrim(safe, F.lit("_")), F.lit(80))
