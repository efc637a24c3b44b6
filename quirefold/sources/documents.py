"""Rows of pages and blocks from documents: providers for real formats, readers for HTML and OOXML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X


class DocumentProvider(Protocol):
    """Opens a document's bytes and yields row dictionaries for the tables of schemas.py.

    Rendering PDF and the like needs libraries that a cluster's image must bring; the engine only sees rows.
    """

    def rows(self, table: str, doc_id: str, content: bytes) -> Iterator[dict]: ...


class OcrProvider(Protocol):
    def words(self, doc_id: str, page_num: int, image: bytes) -> Iterator[dict]: ...


def provided(files: DataFrame, provider: DocumentProvider, table: str, schema) -> DataFrame:
    """Rows of one table from all files (doc_id, content); a document that cannot be read gives none and is logged."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import logging

        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows = list(provider.rows(table, doc_id, content))
                except (ValueError, OSError, RuntimeError) as e:
                    logging.getLogger("quirefold").warning("%s of %s: %s", table, doc_id, e)
                    continue
                if rows:
                    # What a provider leaves out is null.
                    yield pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in schema.fields})

    return files.select("doc_id", "content").mapInPandas(read, schema)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class OoxmlProvider:
    """Paragraphs of DOCX files as text blocks down one page; style names that begin with Heading give sizes."""

    def rows(self, table: str, doc_id: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        seq = 0
        for paragraph in root.iter(f"{_W}p"):
            text = "".join(t.text or "" for t in paragraph.iter(f"{_W}t"))
            if not text.strip():
                continue
            style = next((s.get(f"{_W}val") or "" for s in paragraph.iter(f"{_W}pStyle")), "")
            level = int(m[1]) if (m := re.match(r"Heading(\d)", style)) else 0
            bold = any(True for _ in paragraph.iter(f"{_W}b"))
            y = 40.0 + 14 * seq
            yield {"doc_id": doc_id, "page_num": 1, "seq": seq, "kind": "text", "x0": 72.0, "y0": y, "x1": 540.0, "y1": y + 12, "text": text, "font_size": 10.0 + 2 * (7 - level) * (level > 0), "bold": bold}
            seq += 1


# HTML from the web is not well formed, so elements are found by patterns once scripts, styles and comments are gone.
_GONE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|/p|/li|/h[1-6]|/ul|/ol|/article|/nav|/body|/div)\b)"


def html_text(markup: Column) -> Column:
    """Markup without tags, common entities resolved, white space squeezed."""
    bare = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return X.squeeze(bare)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, tag, text) of headings, paragraphs and list items, in order, blank ones left out."""
    clean = F.regexp_replace(F.col(html_col), _GONE, "")
    tags, bodies = F.regexp_extract_all(clean, F.lit(_BLOCK), 1), F.regexp_extract_all(clean, F.lit(_BLOCK), 2)
    rows = pages.select(F.col(id_col), F.posexplode(F.arrays_zip(tags.alias("tag"), bodies.alias("body"))).alias("pos", "b"))
    return rows.select(id_col, "pos", F.lower("b.tag").alias("tag"), html_text(F.col("b.body")).alias("text")).where("text <> ''")


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, uri, anchor) of links with an address and a visible anchor."""
    clean = F.regexp_replace(F.col(html_col), _GONE, "")
    pattern = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    uris, anchors = F.regexp_extract_all(clean, F.lit(pattern), 1), F.regexp_extract_all(clean, F.lit(pattern), 2)
    rows = pages.select(F.col(id_col), F.posexplode(F.arrays_zip(uris.alias("uri"), anchors.alias("anchor"))).alias("pos", "l"))
    return rows.select(id_col, "pos", "l.uri", html_text(F.col("l.anchor")).alias("anchor")).where("uri <> '' and anchor <> ''")
