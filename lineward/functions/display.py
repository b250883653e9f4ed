"""Display forms of texts, keywords and paths for the report."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineward.functions.binding import let
from lineward.functions.files import base_name

# Widths of the report's columns.
SUMMARY_CHARS = 40
KEYWORDS_SHOWN = 5
PATH_WIDTH = 40
PATH_PREFIX_WIDTH = 14
URL_CHARS = 60
DIRECTORY_CHARS = 40


def sanitize(text: Column, limit: int = SUMMARY_CHARS) -> Column:
    """One line, cut, with the column separator of a Markdown table escaped."""
    flat = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.replace(F.left(flat, F.lit(limit)), F.lit("|"), F.lit("\\|"))


def trim_keywords(joined: Column, shown: int = KEYWORDS_SHOWN) -> Column:
    """The first few keywords and the total when there are more."""
    parts = F.filter(F.transform(F.split(joined, ","), lambda x: F.trim(x)), lambda x: x != "")
    short = F.concat(F.array_join(F.slice(parts, 1, shown), ", "), F.lit(" and more, "),
                     F.size(parts).cast("string"), F.lit(" in all"))
    return F.when(F.size(parts) > shown, short).otherwise(joined)


@lru_cache(maxsize=1)
def wide_ranges() -> str:
    """Character ranges of double display width, for use inside a regular expression class."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        wide = cp <= sys.maxunicode and unicodedata.east_asian_width(chr(cp)) in ("W", "F")
        if wide and start is None:
            start = cp
        elif not wide and start is not None:
            out.append("\\x{%x}-\\x{%x}" % (start, cp - 1))
            start = None
    return "".join(out)


def visual_width(text: Column) -> Column:
    # All before the first wide character is dropped by one range, the rest is tested against all ranges.
    rest = F.regexp_replace(text, "[\\x{0}-\\x{10ff}]++", "")
    return F.char_length(text) + F.char_length(F.regexp_replace(rest, f"[^{wide_ranges()}]++", ""))


def _prefix(text: Column, width: Column | int, at_most: int) -> Column:
    """Longest prefix of limited display width; ``at_most`` bounds its characters."""
    sizes = F.sequence(F.lit(0), F.least(F.char_length(text), F.lit(at_most)))
    return F.left(text, F.array_max(F.filter(sizes, lambda k: visual_width(F.left(text, k)) <= width)))


def truncate_path(path: Column, width: int = PATH_WIDTH) -> Column:
    """A long path as its beginning, ``/.../`` and the file name, itself shortened if need be."""
    def shortened(name: Column, prefix: Column, budget: Column) -> Column:
        dot = F.char_length(name) - F.char_length(F.substring_index(name, ".", -1))
        ext = F.substring(name, dot, F.char_length(name))
        room = F.greatest(budget - visual_width(ext), F.lit(2))
        with_ext = F.concat(_prefix(F.left(name, dot - 1), room - 1, width), F.lit("~"), ext)
        plain = F.concat(F.left(name, F.greatest(budget - 1, F.lit(2))), F.lit("~"))
        cut = F.when(dot > 1, with_ext).otherwise(plain)
        return F.concat(prefix, F.lit("/.../"), F.when(visual_width(name) > budget, cut).otherwise(name))

    def split(p: Column) -> Column:
        prefix = _prefix(p, PATH_PREFIX_WIDTH, PATH_PREFIX_WIDTH)
        return F.struct(base_name(p).alias("name"), prefix.alias("prefix"),
                        (F.lit(width - 4) - visual_width(prefix)).alias("budget"))

    long = let(let(path, split), lambda s: shortened(s["name"], s["prefix"], s["budget"]))
    return F.when(visual_width(path) <= width, path).otherwise(long)


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def table_row(cells: list[Column]) -> Column:
    """One row of a Markdown table; nulls show as empty cells."""
    shown = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
