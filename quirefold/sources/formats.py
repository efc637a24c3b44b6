"""What a file claims to be, what it is, and whether it is let in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats, magic numbers and the suffixes that claim them.
NATIVE = ("cbz", "epub", "fb2", "mobi", "pdf", "xps")
OFFICE = ("docx", "pptx", "xlsx")
SUPPORTED = NATIVE + OFFICE
LEGACY = {"doc": "ole", "ppt": "ole", "xls": "ole"}
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
#: Bytes of a file that are let in, and of its head that are looked at.
LARGEST, HEAD = 50 * 1024 * 1024, 2048
#: Pages above which a converted spreadsheet is worth a warning.
SHEET_PAGES = 50


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, path, content, size): files of a folder or glob, named by the hash of their bytes."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.sha2("content", 256).alias("doc_id"), "path", "content", F.col("length").alias("size"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _zip_names(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Member names of ZIP bytes, null if they are none; an EPUB's mimetype is told by a name of its own."""
    for part in contents:
        yield part.map(_names)


def _names(content: bytes | None) -> list[str] | None:
    if content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "mimetype" in names and b"application/epub+zip" in z.read("mimetype"):
                return ["!epub", *names]
            return names
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError, KeyError):
        return None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType())])))
def zip_members(contents: pd.Series) -> pd.Series:
    def listed(content):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return [{"name": i.filename, "size": i.file_size} for i in z.infolist()]
        except (zipfile.BadZipFile, OSError, TypeError, ValueError):
            return None

    return contents.map(listed)


def zip_kind(names: Column) -> Column:
    within = lambda prefix: F.exists(names, lambda n: F.startswith(n, F.lit(prefix)))
    files = F.filter(names, lambda n: ~F.endswith(n, F.lit("/")))
    image = lambda n: F.lower(n).rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGES) + ")$")
    return (
        F.when(F.array_contains(names, "!epub"), "epub")
        .when(within("word/"), "docx")
        .when(within("xl/"), "xlsx")
        .when(within("ppt/"), "pptx")
        .when(F.exists(names, lambda n: n.rlike(r"\.(fdseq|fpage)$")), "xps")
        .when((F.size(files) > 0) & F.forall(files, image), "cbz")
    )


def sniffed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with found: the format of their bytes, ole for legacy Office, null for none known.

    Magic numbers are compared natively; only ZIP containers reach Python, and those just for
    their list of names.
    """
    c = F.col(content)
    head = F.substring(c, 1, HEAD)
    begins = lambda hexed: F.startswith(c, F.unhex(F.lit(hexed)))
    zipped = begins("504B0304")
    rows = files.withColumn("_names", F.when(zipped, _zip_names(F.when(zipped, c))))
    at60 = F.substring(c, 61, 8)
    fiction = F.contains(head, F.lit("<FictionBook").cast("binary"))
    found = (
        F.when(begins("25504446"), "pdf")
        .when(zipped, zip_kind(F.col("_names")))
        .when(begins("D0CF11E0A1B11AE1"), "ole")
        .when(at60.isin(F.lit("BOOKMOBI").cast("binary"), F.lit("TEXtREAd").cast("binary")), "mobi")
        .when(F.contains(F.substring(c, 1, 68), F.lit("<FictionBook").cast("binary")) | (begins("3C3F786D6C") & fiction), "fb2")
    )
    return rows.withColumn("found", found).drop("_names")


def suffix(name: Column) -> Column:
    """The last suffix of a file name in lower case; empty without one."""
    base = F.regexp_extract(F.lower(name), r"([^/\\]*)$", 1)
    return F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)


def claimed(name: Column) -> Column:
    """The format that a name claims: null without a suffix, ? for one that claims none known."""
    table = {**{f: f for f in SUPPORTED}, **LEGACY}
    known = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), suffix(name))
    return F.when(suffix(name) == "", F.lit(None).cast("string")).otherwise(F.coalesce(known, F.lit("?")))


def gate(claim: Column, found: Column, size: Column, allowed: tuple[str, ...]) -> Column:
    """Why a file is refused, null if it is let in: too_large, unsupported or mismatch.

    The name is judged before the content: a claim that is unknown, legacy or not allowed is unsupported.
    Then the content decides, and must agree with the claim.
    """
    return (
        F.when(size > LARGEST, "too_large")
        .when(claim.isNotNull() & ~claim.isin(*allowed), "unsupported")
        .when(found == "ole", "unsupported")
        .when(found.isNull(), F.when(claim.isNull(), "unsupported").otherwise("mismatch"))
        .when(claim.isNotNull() & (claim != found), "mismatch")
        .when(~found.isin(*allowed), "unsupported")
    )


STATUS = {"unsupported": 415, "mismatch": 422, "too_large": 413}


def gated(files: DataFrame, name: str, allowed: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """files (with found and size) with claim, refusal and status; the good are those without a refusal."""
    rows = files.withColumn("claim", claimed(F.col(name)))
    rows = rows.withColumn("refusal", gate(F.col("claim"), F.col("found"), F.col("size"), allowed))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("refusal"))
    return rows.withColumn("status", F.coalesce(status, F.lit(200)))


def allowlist(formats: list[str], office_available: bool = False) -> tuple[str, ...]:
    """The formats once each, in their order; raises for none, unknown ones, and Office ones without a converter."""
    out = tuple(dict.fromkeys(f.strip().lower() for f in formats))
    if not out:
        raise ValueError("no formats allowed")
    if unknown := [f for f in out if f not in SUPPORTED]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    if not office_available and (office := [f for f in out if f in OFFICE]):
        raise ValueError(f"no converter for: {', '.join(office)}")
    return out


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI; null for any other reference or malformed data."""
    body = F.regexp_extract(uri, r"^data:[^,]*;base64,(.*)$", 1)
    return F.when(uri.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64")))


def exploded_sheets(pages: DataFrame, most: int = SHEET_PAGES) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
