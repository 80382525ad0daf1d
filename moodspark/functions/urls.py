"""URL resolution with built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _drop_dot_segments(path: Column) -> Column:
    """'/a/b/../c/./d' -> '/a/c/d'.  Evaluated only for paths that hold a dot segment."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    closing = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when(joined == "/", joined).otherwise(F.concat(joined, closing))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as seen from the page at ``base``."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"\A([^?#]*)", 1)
    without_fragment = F.regexp_extract(base, r"\A([^#]*)", 1)
    page_path = F.substr(page, F.length(origin) + 1)
    folder = F.regexp_extract(page_path, r"\A(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    raw = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    path = F.regexp_extract(raw, r"\A([^?#]*)", 1)
    rest = F.substr(raw, F.length(path) + 1)
    dotted = path.rlike(r"/\.{1,2}(?:/|\z)")
    return (
        F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", without_fragment)
        .when(href.startswith("#"), F.concat(without_fragment, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(dotted, F.concat(origin, _drop_dot_segments(path), rest))
        .otherwise(F.concat(origin, raw))
    )
