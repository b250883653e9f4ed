"""SQL fragments the oracle statements share."""

from __future__ import annotations

from lineward.functions.keywords import WHITESPACE, combined_pattern


def lit(text: str) -> str:
    """SQL string literal; characters that are hard to see are spelled with chr()."""
    out, plain = [], ""
    for c in text:
        if c.isspace() and c != " " or ord(c) < 32:
            if plain:
                out.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            out.append(f"chr({ord(c)})")
        else:
            plain += c
    if plain or not out:
        out.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


WS = lit(WHITESPACE)


def pattern(keywords: list[str]) -> str:
    return lit(combined_pattern(keywords))


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def lines(src: str, cols: str, text: str = "text") -> str:
    """Non-blank trimmed lines of ``src`` with their 1-based numbers."""
    sel = cols + ", " if cols else ""
    return f"""(SELECT {sel}line_no, line FROM (
        SELECT {sel}CAST(generate_subscripts(string_split({text}, chr(10)), 1) AS INTEGER) AS line_no,
               {strip(f"unnest(string_split({text}, chr(10)))")} AS line
        FROM {src}) WHERE line <> '')"""


def matches(src: str, cols: str, keywords: list[str], text: str = "text") -> str:
    """Lines with a match and the list ``ms`` of surface texts."""
    sel = cols + ", " if cols else ""
    return f"""(SELECT * FROM (SELECT {sel}line_no, line, regexp_extract_all(line, {pattern(keywords)}) AS ms
        FROM {lines(src, cols, text)}) WHERE len(ms) > 0)"""


def joined(ms: str) -> str:
    return f"array_to_string(list_sort(list_distinct({ms})), ', ')"


def context(keywords: list[str], line: str = "line", ms: str = "ms") -> str:
    """Context of the first match, its position found by a second regular expression."""
    pre = f"length(regexp_extract({line}, {lit('^([^\\n]*?)(?:' + combined_pattern(keywords) + ')')}, 1))"
    end = f"({pre} + length({ms}[1]))"
    return f"""CASE WHEN length({line}) <= 120 THEN {line} ELSE
        CASE WHEN {pre} > 40 THEN '...' ELSE '' END
        || substring({line}, greatest(0, {pre} - 40) + 1,
                     least(length({line}), {end} + 40) - greatest(0, {pre} - 40))
        || CASE WHEN {end} + 40 < length({line}) THEN '...' ELSE '' END END"""


def findings(src: str, cols: str, keywords: list[str], text: str = "text") -> str:
    sel = cols + ", " if cols else ""
    return f"""(SELECT {sel}line_no, {context(keywords)} AS content, {joined('ms')} AS keyword
        FROM {matches(src, cols, keywords, text)})"""
