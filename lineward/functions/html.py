"""Visible text and links of HTML held in a string column."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A control character that takes the place of markup while text nodes are separated.
_MARK = "\x01"

# Order matters: elements whose content is not text, before tags in general. Possessive
# quantifiers keep the Java engine from backtracking into long or unterminated tags.
_OPAQUE = (
    r"<!--.*?-->"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)"
)
_TAG = r"""</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
MARKUP = f"(?is){_OPAQUE}|<[!?][^>]*+>|{_TAG}"
OPAQUE = f"(?is){_OPAQUE}"
ANCHOR = r"""(?is)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HREF = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

# ASCII white space; a text node of nothing else counts as one line feed or one blank.
_BLANK_NODE = "^[ \t\n\f\r]+\\z"


# What the numbers 128 to 159 stand for in pages, by the standard (as in Windows-1252).
_HIGH_CONTROLS = {cp: bytes([cp]).decode("cp1252") for cp in range(128, 160) if cp not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _entity_value(token: Column) -> Column:
    """Character for one entity token, the token itself when it is unknown. Leading zeros of a number don't count."""
    body = F.rtrim(F.substring(token, F.lit(2), F.length(token)), F.lit(";"))
    names = F.from_json(F.lit(json.dumps(_named_entities())), "map<string,string>")
    hexed = F.regexp_extract(body, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
    decimal = F.regexp_extract(body, "^#0*([0-9]{1,7})$", 1)
    code = F.coalesce(
        F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("int"),
        F.nullif(decimal, F.lit("")).cast("int"))
    usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    high = F.get(F.array(*[F.lit(_HIGH_CONTROLS.get(cp, chr(cp))) for cp in range(128, 160)]), code - 128)
    return F.coalesce(F.when(code.between(128, 159), high), F.when(usable, char), F.try_element_at(names, body), token)


def _named_entities() -> dict[str, str]:
    """All names of the standard, without their semicolons."""
    return {name.rstrip(";"): value for name, value in html5.items()}


def unescape(c: Column) -> Column:
    """Decode character references in one pass, so that decoded text is never decoded again."""
    tokens = F.regexp_extract_all(c, F.lit("&#?[0-9a-zA-Z]+;?|[^&]+|&"), F.lit(0))
    decoded = F.transform(
        tokens, lambda x: F.when(x.startswith("&") & (x != "&"), _entity_value(x)).otherwise(x))
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def visible_text(html: Column) -> Column:
    """Text nodes in document order, joined by line feeds.

    Comments, declarations and the content of script, style and template elements are left out.
    """
    nodes = F.filter(F.split(F.regexp_replace(html, MARKUP, _MARK), _MARK, -1), lambda x: x != "")
    blank = lambda x: F.when(x.contains("\n"), "\n").otherwise(" ")
    nodes = F.transform(nodes, lambda x: F.when(x.rlike(_BLANK_NODE), blank(x)).otherwise(x))
    return unescape(F.array_join(nodes, "\n"))


def hrefs(html: Column) -> Column:
    """Values of the ``href`` attributes of all anchors, in document order."""
    anchors = F.regexp_extract_all(F.regexp_replace(html, OPAQUE, ""), F.lit(ANCHOR), F.lit(0))
    with_href = F.filter(anchors, lambda a: a.rlike(HREF))
    raw = F.transform(with_href, lambda a: F.btrim(F.regexp_extract(a, HREF, 1), F.lit("\"'")))
    return F.transform(raw, unescape)
