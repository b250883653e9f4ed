"""File names, file heads and ZIP structure as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineward.functions.binding import let_sql

# File types by extension, and the bytes their files start with.
DOCUMENT_EXTS = [".txt", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf"]
ARCHIVE_EXTS = [".zip", ".rar", ".7z"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif"]
ZIP_HEAD = "504B0304"
OLE_HEAD = "D0CF11E0A1B11AE1"
PDF_HEAD = "25504446"
INNER_FOLDERS = [("word/", ".docx"), ("xl/", ".xlsx"), ("ppt/", ".pptx")]
CORE_PARTS = {".docx": "word/document.xml", ".xlsx": "xl/sharedStrings.xml",
              ".pptx": "ppt/slides/slide1.xml"}
LOW_TEXT_SIZE = 10240
LOW_TEXT_CHARS = 10

_DIRECTORY_ENTRY = "PK\x01\x02"
_DIRECTORY_END = "PK\x05\x06"
# The end record may be followed by a comment of at most 65,535 bytes.
_END_SEARCH = 22 + 65535


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^([\s\S]*)/[^/]*$", 1)


def ext(path: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def route(extension: Column) -> Column:
    return (
        F.when(extension.isin(DOCUMENT_EXTS), "document").when(extension.isin(ARCHIVE_EXTS), "archive")
        .when(extension.isin(IMAGE_EXTS), "image").otherwise("unsupported"))


def is_hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


# The ZIP structure is read with SQL expressions over the name of a binary column. They are long,
# and one piece of text reaches the JVM in one call where nested Columns take thousands.

def _number(data: str, start: str | int, width: int) -> str:
    """Unsigned number of 2 or 4 bytes, lowest first, at a 0-based offset."""
    digits = f"hex(substring({data}, cast({start} + 1 as int), {width}))"
    groups = "".join(f"${i}" for i in range(width, 0, -1))
    return f"cast(conv(regexp_replace({digits}, '^{'(..)' * width}$', '{groups}'), 16, 10) as bigint)"


def _directory(content: str) -> str:
    """Bytes of the central directory and how far the archive lies behind where it says it starts.

    The directory ends where the end record begins; the last end mark whose comment ends with the file counts,
    so that marks inside a comment don't. Bytes before the first header move all positions. Null when the
    content is not a ZIP file.
    """
    tail = f"decode(substring({content}, greatest(octet_length({content}) - {_END_SEARCH}, 0) + 1, {_END_SEARCH}), 'ISO-8859-1')"
    # What follows each end mark, to the end of the file.
    ends = let_sql(f"split({tail}, '{_DIRECTORY_END}', -1)", "p", f"""if(size(p) < 2, array(), transform(sequence(2, size(p)),
        i -> encode(concat_ws('{_DIRECTORY_END}', slice(p, i, size(p))), 'ISO-8859-1')))""")
    end = f"element_at(filter({ends}, e -> octet_length(e) >= 18 and octet_length(e) = 18 + {_number('e', 16, 2)}), -1)"
    place = let_sql(f"try_{end}", "e", f"""if(e is null, null, named_struct('length', {_number('e', 8, 4)}, 'start', {_number('e', 12, 4)},
        'end', octet_length({content}) - octet_length(e) - 4))""")
    return let_sql(place, "d", f"""if(d.end >= d.length, named_struct('bytes', substring({content},
        cast(d.end - d.length + 1 as int), cast(d.length as int)), 'shift', d.end - d.length - d.start), null)""")


def _entries(content: str) -> str:
    """Array of the directory entries: name, flags, method, raw size, local header position."""
    raws = f"""transform(filter(split(decode(dir.bytes, 'ISO-8859-1'), '{_DIRECTORY_ENTRY}', -1),
        p -> length(p) >= 42), p -> encode(p, 'ISO-8859-1'))"""
    name = f"substring(r, 43, cast({_number('r', 24, 2)} as int))"
    return let_sql(_directory(content), "dir", f"""transform({raws}, r -> named_struct(
        'name', if({_number('r', 4, 2)} & 2048 != 0 and is_valid_utf8(cast({name} as string)),
                   cast({name} as string), decode({name}, 'ISO-8859-1')),
        'flags', cast({_number('r', 4, 2)} as int), 'method', cast({_number('r', 6, 2)} as int),
        'raw_size', {_number('r', 16, 4)}, 'at', {_number('r', 38, 4)} + dir.shift))""")


_LOCKED_ENTRY = "x -> x.flags & 1 = 1"


def zip_entries(content: str) -> Column:
    return F.expr(_entries(content))


def is_zip(content: str) -> Column:
    return F.expr(f"{_directory(content)} is not null")


def zip_encrypted(content: str) -> Column:
    """Some entry has the encryption flag set."""
    return F.expr(f"coalesce(exists({_entries(content)}, {_LOCKED_ENTRY}), false)")


def zip_members(content: str) -> Column:
    """Array of name, method and raw (still compressed) bytes of all entries; the content is read once.

    The bytes of an entry follow its local header, whose own name and extra field lengths count.
    """
    sizes = f"{_number('c', 'x.at + 26', 2)} + {_number('c', 'x.at + 28', 2)}"
    raw = f"substring(c, cast(x.at + 31 + {sizes} as int), cast(x.raw_size as int))"
    return F.expr(let_sql(content, "c", f"""transform({_entries('c')},
        x -> named_struct('name', x.name, 'method', x.method, 'raw', {raw}))"""))


def detected_ext(extension: str, content: str) -> Column:
    """Type by file head; for ZIP heads by the folders inside, Word when none is known."""
    inner = " ".join(f"when exists(z, x -> contains(x.name, '{folder}')) then '{kind}'" for folder, kind in INNER_FOLDERS)
    return F.expr(f"""case when startswith({content}, X'{ZIP_HEAD}')
            then {let_sql(_entries(content), "z", f"case {inner} else '.docx' end")}
        when startswith({content}, X'{PDF_HEAD}') then '.pdf' else {extension} end""")


def diagnose(extension: str, content: str) -> Column:
    """Why no text came out of a file: encrypted, damaged, missing_lib or unknown."""
    core = "case k " + " ".join(f"when '{kind}' then '{part}'" for kind, part in CORE_PARTS.items()) + " end"
    ooxml = f"""case when z is null then 'damaged' when exists(z, {_LOCKED_ENTRY}) then 'encrypted'
        when exists(z, x -> contains(x.name, 'EncryptedPackage')) then 'encrypted'
        when not exists(z, x -> contains(x.name, {core})) then 'encrypted' else 'damaged' end"""
    # Stream names of the compound format are stored as UTF-16.
    marker = "EncryptionInfo".encode("utf-16-le").hex()
    return F.expr(let_sql(extension, "k", f"""case
        when k in ('.docx', '.xlsx', '.pptx') then {let_sql(_entries(content), "z", ooxml)}
        when k in ('.doc', '.xls', '.ppt') then case when not startswith({content}, X'{OLE_HEAD}') then 'damaged'
            when contains({content}, X'{marker}') then 'encrypted' else 'missing_lib' end
        when k = '.pdf' then if(startswith({content}, X'{PDF_HEAD}') and contains({content}, X'{b"/Encrypt".hex()}'),
            'encrypted', 'damaged') else 'unknown' end"""))


def little_is_all(content: str) -> Column:
    """Not a workbook whose sheets gave the little text there is: it has no part that text could come from, neither a core
    part nor a sheet, or its directory says that it is locked."""
    parts = " or ".join(f"contains(x.name, '{part}')" for part in [*CORE_PARTS.values(), "xl/worksheets/"])
    return F.expr(let_sql(_entries(content), "z", f"""coalesce(not exists(z, x -> {parts}), true)
        or exists(z, {_LOCKED_ENTRY}) or exists(z, x -> contains(x.name, 'EncryptedPackage'))"""))


def low_text(size: Column, text: Column) -> Column:
    """A sizeable file that yields next to no text: labelled, and scanned like any other."""
    from lineward.functions.keywords import strip

    return (size > LOW_TEXT_SIZE) & (F.char_length(strip(text)) < LOW_TEXT_CHARS)
