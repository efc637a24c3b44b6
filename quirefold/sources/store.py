"""Uploaded files under opaque ids, and signed links to them."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.sources.formats import data_uri_bytes

#: Seconds for which a link holds, unless its maker says otherwise.
VALID = 3600
_ID = re.compile(r"[0-9a-f]{32}")


def new_id() -> str:
    """An id that says nothing about the file and cannot be guessed."""
    return secrets.token_hex(16)


def is_id(value: str | None) -> bool:
    return value is not None and _ID.fullmatch(value) is not None


def signature(key: bytes, file_id: str, expires: int) -> str:
    return hmac.new(key, f"{file_id}:{expires}".encode(), hashlib.sha256).hexdigest()


def link(base: str, key: bytes, file_id: str, now: float, valid: int = VALID) -> str:
    """A link to a file's content that holds for `valid` seconds."""
    expires = int(now) + valid
    return f"{base.rstrip('/')}/v1/files/{file_id}/content?expires={expires}&signature={signature(key, file_id, expires)}"


def file_of(url: str, base: str, key: bytes, now: float) -> str | None:
    """The id that a link of our own stands for; None for any other address, a wrong signature, or one whose time is up."""
    m = re.fullmatch(re.escape(base.rstrip("/")) + r"/v1/files/([0-9a-f]{32})/content\?expires=([0-9]{1,12})&signature=([0-9a-f]{64})", url)
    if not m or now > int(m[2]) or not hmac.compare_digest(m[3], signature(key, m[1], int(m[2]))):
        return None
    return m[1]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a text column in hexadecimal, by its definition over two hashes, without Python."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def resolved(requests: DataFrame, files: DataFrame, base: str, key: bytes, now: Column) -> DataFrame:
    """requests (request_id, file_id, url) with content and refusal.

    A request names a stored file by id, by a link of our own whose signature and time hold, or brings its
    bytes as a data URI.  All else is refused: not_found, expired, or unsupported.  No address is ever fetched.
    """
    pattern = "^" + re.escape(base.rstrip("/")) + r"/v1/files/([0-9a-f]{32})/content\?expires=([0-9]{1,12})&signature=([0-9a-f]{64})$"
    part = lambda i: F.regexp_extract("url", pattern, i)
    signed = part(3) == hmac_sha256(key, F.concat_ws(":", part(1), part(2)))
    rows = requests.withColumn("_own", F.coalesce(F.col("url").rlike(pattern), F.lit(False)))
    rows = rows.withColumn("_late", F.col("_own") & signed & (now > part(2).cast("long")))
    asked = F.when(F.col("file_id").rlike("^[0-9a-f]{32}$"), F.col("file_id")).when(F.col("_own") & signed & ~F.col("_late"), part(1))
    rows = rows.withColumn("_asked", asked).withColumn("_inline", F.when(F.col("file_id").isNull(), data_uri_bytes(F.col("url"))))
    held = files.select(F.col("file_id").alias("_asked"), F.col("content").alias("_held"))
    rows = rows.join(held, "_asked", "left").withColumn("content", F.coalesce("_held", "_inline"))
    refusal = F.when(F.col("content").isNotNull(), F.lit(None).cast("string")).when(F.col("_late"), "expired").when(F.col("_asked").isNotNull(), "not_found").otherwise("unsupported")
    return rows.select(*requests.columns, "content", refusal.alias("refusal"))


def multipart(body: bytes, content_type: str, largest: int) -> dict[str, tuple[str | None, bytes]]:
    """Fields of a multipart body: name -> (file name, bytes).  Raises for a body above `largest` or without a boundary."""
    if len(body) > largest:
        raise ValueError("too large")
    m = re.search(r'boundary="?([^";]+)"?', content_type)
    if not m:
        raise ValueError("no boundary")
    out = {}
    for part in body.split(b"--" + m[1].encode())[1:]:
        if part.startswith(b"--"):
            break
        head, _, content = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        line = next((x for x in head.decode("utf-8", "replace").split("\r\n") if x.lower().startswith("content-disposition:")), "")
        name, file = (re.search(rf'[; ]{k}="([^"]*)"', line) for k in ("name", "filename"))
        if name:
            out[name[1]] = (file[1] if file else None, content.removesuffix(b"\r\n"))
    return out
