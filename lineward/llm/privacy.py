"""Personal data: fixed forms by pattern, and terms that give a protected entity away.

A term discloses an entity when seeing the one tells the other: over all whole documents, the pointwise mutual
information of the two is high and the entity stands in most documents with the term. Such terms are removed
wherever they stand in a document of the entity; the entity itself is replaced by its kind. In counts alone, the
words that only one document has are alike: if it is the only one of an entity, all of them disclose it.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import in_batches, map_texts, texts_of, written

# The forms that are always searched, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What counts as a word.
_WORD = re.compile(r"\w+")
#: A term is disclosing if the entity is in this share of the term's documents, and knowing the term raises the
#: entity's likelihood by so many bits; both from exact counts, however few.
LEAST_SHARE, LEAST_BITS = 0.9, 6.0
#: Up to so many rare terms are sent to all tasks; more are joined by a shuffle, with equal results.
_SENT_TERMS = 100_000
#: Terms counted before a task hands on its counts.
_HELD_TERMS = 100_000
#: Parts of a row's mark. Sums of marks tell which rows an entity or a term is in.
_MARKS = ("m0", "m1", "m2")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, found from their @ on: in a long run of letters nothing is tried twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            out.append((start, m.end()))
            after = last = m.end()
        at = text.find("@", after)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (exclusive) of the fixed forms, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _words(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks for the fixed forms, places unchanged."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            a = max(a, at)
            out += [text[at:a], " " * (b - a)]
            at = b
    return "".join(out) + text[at:]


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "doc_id long, row_key binary, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>"


def _found(texts: DataFrame) -> DataFrame:
    """For each row the spans of the fixed forms and the entities, without the text."""

    def run(keys, found):
        spans = [base_spans(t) for t in found]
        return {"doc_id": keys, "row_key": pa.array([_row_key(k, t) for k, t in zip(keys.to_pylist(), found)], pa.binary()),
                **{f"n_{kind}": [sum(k == kind for k, _, _ in own) for own in spans] for kind in KINDS[:4]},
                "base": [_join(own) for own in spans],
                "entities": pa.array([sorted({t[a:b] for _, a, b in own}) for t, own in zip(found, spans)], pa.list_(pa.string()))}

    return map_texts(texts, run, _FOUND)


def _row_key(doc_id: int | None, text: str) -> bytes:
    return hashlib.sha256(f"{doc_id}:{text}".encode()).digest()[:16]


def _term_counts(texts: DataFrame) -> DataFrame:
    """(term, n, m, marks) in parts: rows with it, those of them with an entity, and the sum of the latter's marks."""

    def run(batches):
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])

        def out():
            columns = list(zip(*counts.values())) or [()] * 5
            return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), **{
                name: pa.array(c, pa.int64()) for name, c in zip(("n", "m", *_MARKS), columns)}})

        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids, found):
                spans = base_spans(text)
                words = {w.lower() for w in set(_WORD.findall(_words(text, spans) if spans else text))}
                if not spans:
                    for w in words:
                        counts[w][0] += 1
                else:
                    raw = _row_key(doc_id, text)
                    marks = [int.from_bytes(raw[i:i + 4]) for i in (0, 4, 8)]
                    for w in words:
                        c = counts[w]
                        c[0] += 1
                        c[1] += 1
                        for i, mark in enumerate(marks, 2):
                            c[i] += mark
                if len(counts) > _HELD_TERMS:
                    yield out()
                    counts.clear()
        yield out()

    return in_batches(texts.select("doc_id", "text"), run, "term string, n long, m long, m0 long, m1 long, m2 long")


def _places(texts: DataFrame) -> DataFrame:
    """(row_key, term, places) of the rows with an entity."""

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans := base_spans(text):
                    places: dict[str, list[dict]] = defaultdict(list)
                    for m in _WORD.finditer(_words(text, spans)):
                        places[m.group().lower()].append({"start": m.start(), "end": m.end()})
                    yield pa.RecordBatch.from_pydict({
                        "row_key": pa.array([_row_key(doc_id, text)] * len(places), pa.binary()), "term": pa.array(list(places), pa.string()),
                        "places": pa.array(list(places.values()), _PLACES)})

    return in_batches(texts.select("doc_id", "text"), run, "row_key binary, term string, places array<struct<start:int,end:int>>")


_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _disclosing(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(row_key, places): where the terms are that disclose an entity of their row; all rows count, repeated ones as often.

    Entities in the same rows are one class, and so are terms in the same rows with an entity and as many without:
    they disclose alike, and only classes are paired. Terms and entities too frequent for LEAST_BITS, and terms too
    frequent outside rows with entities for LEAST_SHARE, can't meet the thresholds and aren't paired.
    """
    total = max(1, found.count())
    most = total / 2 ** LEAST_BITS
    sums = [F.sum(name).alias(name) for name in _MARKS]
    terms = _term_counts(texts).groupBy("term").agg(F.sum("n").alias("n_term"), F.sum("m").alias("m"), *sums)
    terms = written(terms.where((F.col("m") >= LEAST_SHARE * F.col("n_term")) & (F.col("n_term") <= most)).select(
        "term", "n_term", F.struct("n_term", "m", *_MARKS).alias("term_class")), "terms")
    sent = F.broadcast(terms) if terms.count() <= _SENT_TERMS else terms  # so that other terms are dropped before the shuffle
    rare = written(_places(texts).join(sent, "term").dropDuplicates(["row_key", "term"]), "rare")

    rows = found.where(F.size("entities") > 0).groupBy("row_key").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"))
    for i, name in enumerate(_MARKS):
        part = F.conv(F.hex(F.substring("row_key", 4 * i + 1, 4)), 16, 10).cast("long")
        rows = rows.withColumn(name, part * F.col("rows"))
    rows = rows.select("row_key", "rows", *_MARKS, F.explode("entities").alias("entity"))
    entities = rows.groupBy("entity").agg(F.sum("rows").alias("n_entity"), *sums).where(F.col("n_entity") <= most).select(
        "entity", "n_entity", F.struct("n_entity", *_MARKS).alias("entity_class"))
    held = written(rows.join(entities, "entity").select("row_key", "rows", "n_entity", "entity_class").distinct(), "entities")

    pairs = held.join(rare.select("row_key", "n_term", "term_class").distinct(), "row_key").where(F.col("n_entity") >= LEAST_SHARE * F.col("n_term"))
    counts = pairs.groupBy("entity_class", "term_class", "n_entity", "n_term").agg(F.sum("rows").alias("both"))
    bits = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    tell = counts.where((F.col("both") >= LEAST_SHARE * F.col("n_term")) & (bits >= LEAST_BITS)).select("entity_class", "term_class")
    where = pairs.join(tell, ["entity_class", "term_class"]).select("row_key", "term_class").distinct()
    return rare.join(where, ["row_key", "term_class"]).select("row_key", "places")


def _term_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their base spans, and for the rows that have any the spans of disclosing terms."""
    texts = texts_of(docs)
    found = written(_found(texts), "found")
    spans = _disclosing(texts, found).groupBy("row_key").agg(
        F.array_sort(F.flatten(F.collect_list("places"))).alias("terms"))
    return found, spans


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs(doc_id, text)``.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the fixed forms' spans) and spans: kind:start:end
    in code points, by kind, then start; ``term`` spans are the disclosing ones. Null and empty texts have
    none; repeated rows come back as often as they are there, rows without id keep a null id.
    """
    found, spans = _term_spans(docs)
    listed = F.transform("terms", lambda s: F.concat(F.lit("term:"), s["start"], F.lit(":"), s["end"]))
    return found.join(spans, "row_key", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")),
                              F.coalesce(listed, F.array().cast("array<string>"))), ",").alias("spans"))


def _clean(text: str, terms: list) -> str:
    """Entities become their kind in angle brackets, the given spans go; of spans that overlap the first counts."""
    spans = [(a, b, f"<{k}>") for k, a, b in base_spans(text)] + [(t["start"], t["end"], "") for t in terms or []]
    out, at = [], 0
    for a, b, name in sorted(spans):
        if a >= at:
            out += [text[at:a], name]
            at = b
        elif b > at:
            at = b  # what sticks out of the first goes with it
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, texts without personal data; a null text stays null.

    Texts are rewritten where they are read. Only rows with disclosing terms carry them in, by a join
    for the rows that have a fixed form at all; the texts of the others are in no shuffle. ``n_chars`` follows the
    text if it is there.
    """
    _, spans = _term_spans(docs)
    key = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")), F.lit(":"),
                                              F.coalesce("text", F.lit(""))), 256), 1, 32))
    maybe = F.coalesce(F.col("text").rlike(r"@|\+[0-9]|[0-9][ -]?[0-9]|\.[0-9]"), F.lit(False))
    whole = docs.select(F.struct("*").alias("row"), F.when(maybe, key).alias("row_key"))
    rows = whole.where("row_key is not null").join(spans, "row_key", "left").select("row", "terms")
    rows = rows.union(whole.where("row_key is null").select("row", F.lit(None).cast("array<struct<start:int,end:int>>")))
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = batch.column(0).flatten()
            texts, terms = found[at].to_pylist(), batch.column(1).to_pylist()
            found[at] = pa.array([None if t is None else _clean(t, x) for t, x in zip(texts, terms)], found[at].type)
            yield pa.RecordBatch.from_arrays(found, columns)

    out = in_batches(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
