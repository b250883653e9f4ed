"""WARC archives of page snapshots: written, stripped of payloads that repeat, and read back.

Archives are gzip files with a member for each record. Only record headers are shuffled, by the digest of their
payload; payloads go from file to file. Of records with equal payloads one stays a response, the others become
revisits: records without payload that name the response by its record id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import joined_to_groups, shared_folder, store_of, written

#: Bytes and records after which a task starts its next file.
FILE_BYTES, FILE_RECORDS = 256 << 20, 50_000
_LEVEL, _READ = 4, 1 << 20

# Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

_HEADERS = "file string, at long, record_id string, page_id long, url string, date string, digest string, n_bytes long"
_FILES = "file string, records long"
_RECORDS = ("file string, record_id string, record_type string, page_id long, url string, digest string, n_bytes long, "
            "refers_id string, intact boolean, payload binary")


def payload_digest(raw: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def _uri(url: str) -> str:
    """A header value stays on its line: control characters and blanks as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    lines = [_VERSION, *[f"{k}: {v}".encode() for k, v in fields if v is not None], b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", _LEVEL, mtime=0)


def _page_record(kind: str, header: dict, payload: bytes, target: dict | None = None) -> bytes:
    """A response, or a revisit of ``target`` (record_id, url and date of a response) without its payload."""
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % header["n_bytes"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{header['record_id']}>"), ("WARC-Date", header["date"]),
              ("WARC-Target-URI", header["url"]), ("WARC-Payload-Digest", f"sha1:{header['digest']}"),
              ("Page-ID", header["page_id"]), ("Content-Type", "application/http; msgtype=response")]
    if target is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{target['record_id']}>"),
                   ("WARC-Refers-To-Target-URI", target["url"]), ("WARC-Refers-To-Date", target["date"])]
        payload = b""
    return _member(fields, http + payload)


class _Writer:
    """Files of one task, each begun with a warcinfo record; names are its own, so no other attempt writes them."""

    def __init__(self, folder: str, file_bytes: int, date: str):
        task = TaskContext.get()
        self.store, self.folder = store_of(folder)
        self.name = f"{task.partitionId():06}-{task.taskAttemptId()}"
        self.file_bytes, self.date, self.files, self.out = file_bytes, date, 0, None

    def add(self, member: bytes) -> tuple[str, int]:
        """Append a record and say where it is: file, and number in the file."""
        if self.out is None or self.held + len(member) > self.file_bytes or self.records >= FILE_RECORDS:
            self.close()
            self.file, self.held, self.records = f"{self.name}-{self.files:05}.warc.gz", 0, 0
            self.files += 1
            self.out = self.store.open_output_stream(f"{self.folder}/{self.file}", compression=None)
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", self.date),
                    ("WARC-Filename", self.file), ("Content-Type", "application/warc-fields")]
            self.out.write(_member(info, b"format: WARC File Format 1.1\r\n"))
        self.out.write(member)
        self.held, self.records = self.held + len(member), self.records + 1
        return self.file, self.records - 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def _members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    raw = stream.read(_READ)
    while raw:
        plain, unzip = [], zlib.decompressobj(31)
        while not unzip.eof:
            if not raw:
                raise ValueError("archive ends within a record")
            plain.append(unzip.decompress(raw))
            raw = unzip.unused_data if unzip.eof else stream.read(_READ)
        raw = raw or stream.read(_READ)
        yield b"".join(plain)


def read_file(store, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, names in lower case, and block of every record of a file."""
    with store.open_input_stream(path, compression=None) as stream:
        for record in _members(stream):
            head, _, rest = record.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            yield fields, rest[:int(fields["content-length"])]


def _pages_of(store, path: str) -> Iterator[tuple[dict, bytes]]:
    """Headers and payload of the responses and revisits of a file."""
    for fields, block in read_file(store, path):
        kind = fields["warc-type"]
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
            named = fields["warc-payload-digest"].removeprefix("sha1:")
            own = payload_digest(payload) if kind == "response" else named
            page = fields.get("page-id")
            yield {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "page_id": None if page is None else int(page),
                   "url": fields.get("warc-target-uri"), "date": fields["warc-date"], "digest": own, "intact": own == named,
                   "n_bytes": len(payload) if kind == "response" else None, "refers_id": fields.get("warc-refers-to", "").strip("<>") or None}, payload


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, folder: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a response for every row of ``pages(page_id, url, html)``, payload the html in UTF-8.

    Returns the records' headers: file, at (number in the file), record_id, page_id, url, date, digest and n_bytes
    of the payload. Only files that this table names belong to the archive; an attempt that was
    lost leaves others. Null html is an empty payload; null ids and urls have no field. Repeated rows are
    records of their own. Control characters and blanks of a url are escaped. No pages: no files, no rows.
    """
    date = date or _now()
    store_of(folder)[0].create_dir(store_of(folder)[1])

    def run(batches):
        out = _Writer(folder, file_bytes, date)
        for batch in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (html or "").encode()
                header = {"record_id": uuid.uuid4().urn, "page_id": page, "url": None if url is None else _uri(url), "date": date,
                          "digest": payload_digest(raw), "n_bytes": len(raw)}
                file, at = out.add(_page_record("response", header, raw))
                rows.append({**header, "file": file, "at": at})
            yield _rows(rows, _HEADERS)
        out.close()

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, _HEADERS), "headers")


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """Add ``target`` to headers: record_id, url and date of the response that a record revisits, null for responses.

    Of records with equal payloads of at least ``least`` bytes that with the largest page_id is the response, of
    several such one of them; null ids are smallest. A payload that most records share isn't gathered: its
    records are counted before the shuffle.
    """
    first = F.max(F.struct("page_id", "record_id", "url", "date"))
    groups = headers.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(first.alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("digest", "n_bytes", F.struct("first.record_id", "first.url", "first.date").alias("first"), "n"), "payloads")
    known = joined_to_groups(headers, groups, ["digest", "n_bytes"], "n", headers.count())
    target = F.when(F.col("first.record_id") != F.col("record_id"), F.col("first"))
    return known.select(*headers.columns, target.alias("target"))


def _by_file(rows: DataFrame) -> DataFrame:
    """Rows of a file in one task, files dealt to tasks by their number of rows."""
    files = rows.agg(F.count_distinct("file")).first()[0]
    return rows.repartitionByRange(max(1, files), "file")


def deduplicate(resolved: DataFrame, source: str, folder: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive in ``source`` anew: records with a ``target`` as revisits, all with fresh headers.

    Returns (file, records) of the new archive. Records keep their ids. A task reads a file and its headers side
    by side, both in the order of the file.
    """
    date = date or _now()
    store_of(folder)[0].create_dir(store_of(folder)[1])

    def run(batches):
        store, old = store_of(source)
        out, counts = _Writer(folder, file_bytes, date), {}
        now, records = None, None
        for batch in batches:
            for header in batch.to_pylist():
                if header["file"] != now:
                    now, records = header["file"], _pages_of(store, f"{old}/{header['file']}")
                found, payload = next(records)
                if found["record_id"] != header["record_id"]:
                    raise ValueError(f"{now} and its headers differ at {header['at']}")
                file, at = out.add(_page_record("revisit" if header["target"] else "response", header, payload, header["target"]))
                counts[file] = at + 1
        out.close()
        yield _rows([{"file": k, "records": v} for k, v in counts.items()], _FILES)

    return written(_by_file(resolved).sortWithinPartitions("file", "at").mapInArrow(run, _FILES), "files")


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The responses and revisits of the files that ``files(file)`` names.

    file, record_id, record_type, page_id, url, digest (of a response that of the bytes read), n_bytes (null for
    revisits), refers_id, intact (whether the digest is the one in the header), and payload, or null without ``payloads``.
    """

    def run(batches):
        store, path = store_of(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for header, payload in _pages_of(store, f"{path}/{file}"):
                    rows.append({**header, "file": file, "payload": payload if payloads and header["record_type"] == "response" else None})
                    held += len(payload) if payloads else 0
                    if len(rows) == 1000 or held > _READ << 4:
                        yield _rows(rows, _RECORDS)
                        rows, held = [], 0
                yield _rows(rows, _RECORDS)

    return _by_file(files.select("file")).mapInArrow(run, _RECORDS)


def described(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to (a page_id) of each record of an archive.

    Revisits are joined to their responses, which they name by record id; a response with very many is sent to them.
    """
    records = written(records.drop("payload"), "records")
    revisits = records.where("record_type = 'revisit'").select("refers_id", "page_id", "url", "digest")
    responses = records.where("record_type = 'response'")
    groups = revisits.groupBy("refers_id").agg(F.count("*").alias("n"))
    own = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("payload_bytes"))
    groups = written(groups.join(own, "refers_id"), "targets")
    found = joined_to_groups(revisits, groups, ["refers_id"], "n", revisits.count())
    return responses.select("page_id", "url", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
                            F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select("page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


def archived(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive, deduplicate it, read the result back and describe its records.

    A row for every row of ``pages``. See the steps for null ids, null html, repeated rows and empty tables.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    headers = write_archives(pages, f"{folder}/captured")
    files = deduplicate(resolve(headers, least), f"{folder}/captured", f"{folder}/archive")
    return described(read_archives(files, f"{folder}/archive", payloads=False))
