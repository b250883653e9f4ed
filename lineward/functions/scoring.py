"""Prompts for a scorer and the reading of its answers, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineward.functions.binding import let
from lineward.functions.keywords import strip

# Lines per request, characters per request and how many of them the next one repeats, and
# limits of what is shown.
BATCH_LINES = 10
MAX_CHARS = 4000
OVERLAP_CHARS = 200
LOCATE_CHARS = 30
CONTENT_CHARS = 120
FALLBACK_CHARS = 200
AFFIRMATIVE = ["true", "是", "包含", "涉密"]
UNKNOWN = "unknown"

_INSTRUCTION = (
    "You are checking a text for confidential terms: {keywords}.\n"
    "Report each place where one of them is written, however it is spaced or punctuated and whatever it means "
    "there. If none is written, report nothing.\n"
    'Reply with one JSON object, {{"has_sensitive": true|false, "matches": [{{"keyword": "", "context": "", '
    '"reason": ""}}]}}; a context repeats the words of the text around the place.\n'
    "Text:\n"
)
_MATCH = "keyword:string,context:string,reason:string"
_ANSWER = f"has_sensitive:string,matches:array<struct<{_MATCH}>>"


def windows(text: Column) -> Column:
    """Array of (window_no, part): a text that is too long for one request in overlapping parts, all of it."""
    step = MAX_CHARS - OVERLAP_CHARS
    more = F.greatest(F.lit(0), F.ceil((F.char_length(text) - MAX_CHARS) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda i: F.struct(
        i.alias("window_no"), F.substring(text, i * step + 1, F.lit(MAX_CHARS)).alias("part")))


def instruction(keywords: list[str]) -> str:
    return _INSTRUCTION.format(keywords=", ".join(keywords))


def prompt(part: Column, keywords: list[str]) -> Column:
    return F.concat(F.lit(instruction(keywords)), part)


def batches(text: Column) -> Column:
    """Array of (start, lines) for consecutive runs of lines, blank lines included."""
    lines = F.split(text, "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / BATCH_LINES).cast("int"))
    return F.transform(starts, lambda i: F.struct(
        (i * BATCH_LINES).alias("start"),
        F.slice(lines, i * BATCH_LINES + 1, F.lit(BATCH_LINES)).alias("lines")))


def parse(response: Column) -> Column:
    """``struct<has_sensitive, matches, parse_status>`` of an answer.

    The text from the first opening to the last closing brace is read as JSON, with missing fields
    defaulted. Anything else is judged by affirmative words, with one match of unknown keyword.
    The braces are read as the only element of an array: text between two objects, which would be
    passed over behind an object, then makes the whole unreadable.
    """
    def read(text: Column) -> Column:
        body = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
        answers = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{_ANSWER}>>",
                              {"allowSingleQuotes": "false"})
        return F.struct(text.alias("text"), F.when(body != "", answers).alias("answers"))

    def judge(r: Column) -> Column:
        answer, text = F.get(r["answers"], F.lit(0)), r["text"]
        valid = F.coalesce(F.size(r["answers"]) == 1, F.lit(False))
        said = ~F.coalesce(answer["has_sensitive"], F.lit("")).isin("", "false", "null", "0", "[]", "{}")
        matches = F.transform(
            F.coalesce(answer["matches"], F.array().cast(f"array<struct<{_MATCH}>>")),
            lambda m: F.struct(
                F.coalesce(m["keyword"], F.lit(UNKNOWN)).alias("keyword"),
                F.coalesce(m["context"], F.lit("")).alias("context"),
                F.coalesce(m["reason"], F.lit("")).alias("reason")))
        affirmative = reduce(lambda a, b: a | b, [text.contains(w) for w in AFFIRMATIVE])
        guess = F.array(F.struct(
            F.lit(UNKNOWN).alias("keyword"), F.left(text, F.lit(FALLBACK_CHARS)).alias("context"),
            F.lit("unreadable answer").alias("reason")))
        return F.when(text.isNotNull(), F.struct(
            F.when(valid, said).otherwise(affirmative).alias("has_sensitive"),
            F.when(valid, matches).otherwise(guess).alias("matches"),
            F.when(valid, "json").otherwise("inferred").alias("parse_status")))

    return let(let(strip(response), read), judge)


def locate(lines: Column, start: Column, context: Column) -> Column:
    """Number of the line where the context is: the first that holds the context's first line, else the
    first that holds its beginning, else the first of all."""
    def position(short: Column) -> Column:
        return F.nullif(F.array_position(F.transform(lines, lambda x: x.contains(short)), True), F.lit(0))

    def first(c: Column) -> Column:
        hit = F.when(c["line"] != "", F.coalesce(position(c["line"]), F.when(c["short"] != "", position(c["short"]))))
        return (start + F.coalesce(hit, F.lit(1))).cast("int")

    whole = strip(context)
    return let(F.struct(strip(F.substring_index(whole, "\n", 1)).alias("line"),
                        strip(F.left(context, F.lit(LOCATE_CHARS))).alias("short")), first)
