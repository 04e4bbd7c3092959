"""Attachment functions: extensions, types by leading bytes, entropy, storage keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
DANGEROUS = ["exe", "scr", "bat", "cmd", "com", "pif", "vbs", "vbe", "js", "jse", "wsf", "wsh", "ps1", "msi", "jar", "cpl", "hta", "lnk", "reg", "dll", "sys", "scf", "gadget", "msc", "ws", "msp", "inf", "sh", "run"]
MACRO = ["docm", "dotm", "xlsm", "xltm", "xlam", "pptm", "potm", "ppam", "ppsm", "sldm"]
ARCHIVES = ["zip", "gz", "tgz", "bz2", "7z", "rar", "tar", "xz"]
MIME = {"pdf": ["application/pdf"], "png": ["image/png"], "jpg": ["image/jpeg"], "jpeg": ["image/jpeg"], "gif": ["image/gif"], "bmp": ["image/bmp"], "webp": ["image/webp"], "txt": ["text/plain"], "csv": ["text/csv", "text/plain"], "html": ["text/html"], "json": ["application/json", "text/plain"], "xml": ["application/xml", "text/xml", "text/plain"], "doc": ["application/msword", "application/x-ole-storage"], "xls": ["application/vnd.ms-excel", "application/x-ole-storage"], "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip"], "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip"], "pptx": ["application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/zip"]}
MAGIC = {"4D5A": "application/x-msdownload", "7F454C46": "application/x-elf", "25504446": "application/pdf", "504B0304": "application/zip", "504B0506": "application/zip", "504B0708": "application/zip", "D0CF11E0": "application/x-ole-storage", "52617221": "application/x-rar-compressed", "1F8B": "application/gzip", "377ABCAF271C": "application/x-7z-compressed", "FFD8FF": "image/jpeg", "89504E47": "image/png", "47494638": "image/gif"}


def ext_of(name: Column) -> Column:
    """Lower-cased last extension without the dot, after trailing dots and blanks are dropped; '' if none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"[.\s]+$", ""), r"\.([^./\\]*)$", 1))


def prior_ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"[.\s]+$", ""), r"\.([^./\\]+)\.[^./\\]*$", 1))


def is_dangerous(name: Column) -> Column:
    return ext_of(name).isin(DANGEROUS)


def is_macro(name: Column) -> Column:
    return ext_of(name).isin(MACRO)


def is_double_extension(name: Column) -> Column:
    """A dangerous last extension after one that is dangerous or a known document or media type."""
    return is_dangerous(name) & prior_ext(name).isin(DANGEROUS + list(MIME))


def mime_mismatch(name: Column, declared: Column, detected: Column) -> Column:
    """A declared or detected type that a known extension (no archive) doesn't go with."""
    table = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    expected = F.element_at(table, ext_of(name))
    clean = lambda c: F.lower(F.trim(F.substring_index(F.coalesce(c, F.lit("")), ";", 1)))
    off = lambda c: (clean(c) != "") & (clean(c) != "application/octet-stream") & ~F.array_contains(expected, clean(c))
    return F.coalesce(expected.isNotNull() & (off(declared) | off(detected)), F.lit(False))


def magic_type(data: Column) -> Column:
    """Content type by the leading bytes; application/octet-stream if unknown, '' for no bytes."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.when(F.octet_length(data) == 0, "")
    for prefix, kind in MAGIC.items():
        out = out.when(F.startswith(head, F.lit(prefix)), kind)
    return out.otherwise("application/octet-stream")


def object_key(sha: Column) -> Column:
    return F.concat(F.lit("attachments/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha)


def is_hex_hash(s: Column, size: int = 64) -> Column:
    return F.coalesce(s.rlike(f"^[0-9a-f]{{{size}}}$"), F.lit(False))


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Entropy in bits a byte, 0 to 8. Python by Arrow batches: bytes have no built-in histogram."""

    def one(x: bytes | None) -> float | None:
        if x is None:
            return None
        p = np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) / max(len(x), 1)
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum()) if len(x) else 0.0

    return data.map(one)


def threat_tags(high_entropy: Column, mismatch: Column, dangerous: Column, macros: Column, double: Column, malicious: Column) -> Column:
    flags = {"malicious_hash": malicious, "high_entropy": high_entropy, "extension_mismatch": mismatch, "dangerous_extension": dangerous, "macro_office": macros, "double_extension": double}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
