"""Fuzzy keyword patterns and the Column expressions built on them.

A keyword matches when its characters appear in order with at most two other characters between
neighbours, on one line, in any letter case. The pattern spells out the case variants of every
character and the excluded line feed, so it carries no flags and means the same in Java regular
expressions, in RE2 and in Python.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rule.
MAX_GAP = 2
CONTEXT_CHARS = 40
WHOLE_LINE_CHARS = 120
DEFAULT_KEYWORDS = ["涉密", "秘密", "机密", "绝密", "保密", "泄密"]

# Everything Unicode counts as white space, as one string of characters to trim.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

_REGEX_SPECIAL = set("\\^$.|?*+()[]{}-&~#")


def parse_keywords(csv: str) -> list[str]:
    """Comma-separated user input to an ordered keyword list."""
    return [part for part in (p.strip() for p in csv.split(",")) if part]


def parse_keywords_col(csv: Column) -> Column:
    """The same split for a column of comma-separated strings."""
    return F.filter(F.transform(F.split(csv, ","), strip), lambda x: x != "")


@lru_cache(maxsize=1)
def _case_index() -> dict[str, set[str]]:
    """Characters grouped by the single-character case mappings they share."""
    index: dict[str, set[str]] = defaultdict(set)
    for c in map(chr, range(sys.maxunicode + 1)):
        for mapped in {c.lower(), c.upper(), c.casefold()}:
            if mapped != c:
                index[mapped[0]].add(c)
                index[c].add(mapped[0])
    return index


@lru_cache(maxsize=4096)
def case_variants(ch: str) -> tuple[str, ...]:
    """All characters equal to ``ch`` when letter case is ignored, ``ch`` included."""
    index = _case_index()
    near = {ch} | index.get(ch, set())
    near |= {b for a in near for b in index.get(a, set())}
    same = re.compile(re.escape(ch), re.IGNORECASE)
    return tuple(sorted(c for c in near if same.fullmatch(c)))


def _escape(ch: str) -> str:
    return "\\" + ch if ch in _REGEX_SPECIAL else ch


def char_pattern(ch: str) -> str:
    variants = case_variants(ch)
    if len(variants) == 1:
        return _escape(ch)
    return "[" + "".join(map(_escape, variants)) + "]"


def fuzzy_pattern(keyword: str) -> str:
    return ("[^\\n]{0,%d}?" % MAX_GAP).join(map(char_pattern, keyword))


def combined_pattern(keywords: list[str]) -> str | None:
    """One alternation in list order; ``None`` when there is nothing to look for."""
    parts = ["(?:" + fuzzy_pattern(k) + ")" for k in keywords if k]
    return "|".join(parts) if parts else None


def search_pattern(keywords: list[str]) -> str | None:
    """The alternation behind a look-ahead for its possible first characters.

    The look-ahead changes no result; it lets the Java engine skip most positions with one test.
    """
    pattern = combined_pattern(keywords)
    if pattern is None:
        return None
    firsts = sorted({v for k in keywords if k for v in case_variants(k[0])})
    return "(?=[" + "".join(map(_escape, firsts)) + "])(?:" + pattern + ")"


def is_padded(keywords: list[str]) -> bool:
    """Some keyword starts or ends with white space, so that trimming a line may undo its match."""
    return any(k != k.strip() for k in keywords)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def has_match(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def all_matches(c: Column, pattern: str) -> Column:
    """Surface texts of the non-overlapping matches, left to right."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def joined_forms(matches: Column) -> Column:
    """Distinct surface texts in code point order, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(matches)), ", ")


def context(line: Column, first: Column) -> Column:
    """A short line whole, a long one cut to the surroundings of its first match.

    The first match starts where its own text first occurs: an earlier occurrence would have been
    an earlier match. So a plain substring search gives the position.
    """
    size = F.char_length(line)
    start = F.instr(line, first) - 1
    left = F.greatest(F.lit(0), start - CONTEXT_CHARS)
    right = F.least(size, start + F.char_length(first) + CONTEXT_CHARS)
    cut = F.concat(
        F.when(left > 0, "...").otherwise(""),
        F.substring(line, left + 1, right - left),
        F.when(right < size, "...").otherwise(""),
    )
    return F.when(size <= WHOLE_LINE_CHARS, line).otherwise(cut)


def contains_any(columns: list[Column], keywords: list[str], ignore_case: bool = True) -> Column:
    """Literal substring test over columns and keywords.

    Case-sensitive tests reach Parquet and JDBC scans as pushed ``contains`` filters.
    """
    tests = [
        F.lower(c).contains(k.lower()) if ignore_case else c.contains(k)
        for c in columns for k in keywords if k
    ]
    return reduce(or_, tests) if tests else F.lit(False)


def may_match(c: Column, keywords: list[str]) -> Column:
    """Necessary condition of a fuzzy match: all characters of some keyword occur.

    Characters without case variants are tested on the column itself, so that for scripts without
    letter case the whole condition can be pushed to the scan.
    """
    def occurs(ch: str) -> Column:
        return reduce(or_, [c.contains(v) for v in case_variants(ch)])

    tests = [reduce(and_, [occurs(ch) for ch in sorted(set(k))]) for k in keywords if k]
    return reduce(or_, tests) if tests else F.lit(False)
