"""RFC 822 messages to structs: headers, bodies, attachments. Python by Arrow batches: MIME has no built-in reader."""

from __future__ import annotations

import email
import email.policy
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PARTS = 200
SCHEMA = """id string, message_id string, subject string, sender string, reply_to string, return_path string, recipients array<string>, sent_timestamp long, received array<string>, auth_results string, mailer string,
    plain string, html string, charset string, attachments array<struct<filename:string,content_type:string,sha256:string,md5:string,size_bytes:long,entropy:double>>, error string"""


def entropy(b: bytes) -> float:
    return -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values()) if b else 0.0


def parsed(key: str, raw: bytes | None) -> dict:
    out = dict.fromkeys((x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ") if " " in x and "<" not in x.split()[0]), None)
    out = {k: out.get(k) for k in ("id", "message_id", "subject", "sender", "reply_to", "return_path", "recipients", "sent_timestamp", "received", "auth_results", "mailer", "plain", "html", "charset", "attachments", "error")}
    out |= {"id": key, "recipients": [], "received": [], "attachments": []}
    try:
        m = email.message_from_bytes(raw or b"", policy=email.policy.default)
        header = lambda k: str(m[k]) if m[k] is not None else None
        out |= {"message_id": (header("Message-ID") or "").strip().strip("<>") or None, "subject": header("Subject"), "sender": header("From"), "reply_to": header("Reply-To"), "return_path": header("Return-Path"), "auth_results": header("Authentication-Results"), "mailer": header("X-Mailer")}
        out["recipients"] = [a for _, a in getaddresses([str(x) for k in ("To", "Cc", "Bcc") for x in m.get_all(k, [])]) if a]
        out["received"] = [str(x) for x in m.get_all("Received", [])]
        if m["Date"]:
            out["sent_timestamp"] = int(parsedate_to_datetime(str(m["Date"])).timestamp())
        for n, part in enumerate(m.walk()):
            if n >= MAX_PARTS:
                break
            if part.is_multipart():
                continue
            kind, name = part.get_content_type(), part.get_filename()
            data = part.get_payload(decode=True) or b""
            if name or part.get_content_disposition() == "attachment":
                out["attachments"].append({"filename": name, "content_type": kind, "sha256": hashlib.sha256(data).hexdigest(), "md5": hashlib.md5(data).hexdigest(), "size_bytes": len(data), "entropy": entropy(data)})  # noqa: S324
            elif kind in ("text/plain", "text/html"):
                charset = part.get_content_charset() or "utf-8"
                try:
                    body = data.decode(charset, "replace")
                except LookupError:
                    body = data.decode("utf-8", "replace")
                slot = "plain" if kind == "text/plain" else "html"
                out[slot] = (out[slot] or "") + body.replace("\x00", "")
                out["charset"] = out["charset"] or charset
    except Exception as e:  # noqa: BLE001  a malformed message is a row with an error, not a failed job
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def parse(raw: DataFrame, key: str = "id", content: str = "raw") -> DataFrame:
    """Messages of a table of (key, bytes). Broken ones have `error`; the rest of their fields as far as read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parsed(k, None if c is None else bytes(c)) for k, c in zip(b[key], b[content], strict=True)])

    return raw.select(F.col(key).cast("string").alias(key), content).mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of .eml files."""
    return parse(spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("content").alias("raw")))
