"""File kinds, decoding and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V


def extension(path: Column) -> Column:
    """Last suffix with its dot, lower case; '' where there is none (also for dot files)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./]+)$", 1))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def file_type_by_ext(path: Column) -> Column:
    ext = extension(path)
    out = None
    for kind, exts in V.FILE_TYPE_BY_EXTENSION.items():
        test = ext.isin(exts)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def file_type_by_magic(content: Column) -> Column:
    """Signature of the first bytes; a ZIP that names word/document.xml; printable ASCII is text."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for signature, kind in V.MAGIC_HEX:
        test = head.startswith(signature)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    body = F.decode(content, "ISO-8859-1")
    docx = head.startswith(V.ZIP_HEX) & F.contains(body, F.lit("word/document.xml"))
    text = F.decode(F.substring(content, 1, 1024), "ISO-8859-1").rlike(r"^[\x20-\x7e\n\r\t]*\z")
    return out.when(docx, "docx").when(text, "text").otherwise("unknown")


def detect_file_type(path: Column, content: Column) -> Column:
    by_ext = file_type_by_ext(path)
    return F.when(by_ext != "unknown", by_ext).otherwise(file_type_by_magic(content))


def file_kind_six(path: Column) -> Column:
    return _lookup(extension(path), V.FILE_KIND_SIX, "unknown")


def file_kind_image_default(path: Column) -> Column:
    """Kind by what follows the last dot; anything else is taken for an image."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    out = None
    for kind, exts in V.FILE_KIND_IMAGE_DEFAULT.items():
        out = F.when(ext.isin(exts), kind) if out is None else out.when(ext.isin(exts), kind)
    return out.otherwise("image")


def file_kind_generic(path: Column) -> Column:
    return _lookup(extension(path), V.GENERIC_EXTENSIONS, "unsupported")


def is_upload_allowed(path: Column, mime: Column) -> Column:
    return extension(path).isin(V.UPLOAD_EXTENSIONS) & mime.isin(V.UPLOAD_MIME_TYPES)


def reject_reason(path: Column, length: Column, max_bytes: int = V.MAX_FILE_BYTES) -> Column:
    """Why a file is not processed; null when it is."""
    return F.when(length > max_bytes, "too_large").when(
        file_kind_six(path) == "unknown", "unsupported_format"
    )


def decode_text(content: Column) -> Column:
    """UTF-8 (with or without mark) where valid, else Latin-1; line ends become newlines."""
    valid = F.is_valid_utf8(content.cast("string"))
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    text = F.when(valid, utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def safe_upload_name(ts: Column, name: Column) -> Column:
    stem = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), stem)
