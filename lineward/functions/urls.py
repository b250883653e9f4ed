"""URL parts and relative references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Network location, port included; empty when there is none."""
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.reduce(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(kept, tail), "/")
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), rooted).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page ``base``.

    A chain of cases on the shape of the reference; segment lists are only built for references
    that are relative to a directory or contain dot segments.
    """
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    ref_path = F.regexp_extract(ref, "^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*([\s\S]*)$", 1)
    base_dir = F.regexp_extract(_path(base), r"^([\s\S]*/)", 1)
    directory = F.when(base_dir == "", "/").otherwise(base_dir)
    relative = F.regexp_replace(F.concat(directory, ref_path), "//+", "/")
    return (
        F.when(ref == "", base)
        .when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, _remove_dots(ref_path), ref_tail))
        .when(ref.startswith("?"), F.concat(root, _path(base), ref))
        .when(ref.startswith("#"), F.concat(strip_fragment(base), ref))
        .otherwise(F.concat(root, _remove_dots(relative), ref_tail))
    )
