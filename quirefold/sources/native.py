"""Readers for formats that the standard library can open: EPUB, FB2, CBZ, and OOXML presentations and workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

#: A page of flowing text, in points, and its lines.
WIDTH, HEIGHT, LINES = 612.0, 792.0, 50
LEFT, RIGHT, TOP, STEP = 72.0, 540.0, 40.0, 14.0
BODY = 10.0
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")


class EncryptedError(ValueError):
    """A document that only opens with a password."""


def refuse_encrypted(found: str | None, content: bytes) -> None:
    """Raises for PDF and ZIP files that are locked, and for legacy containers around encrypted Office files."""
    if found == "pdf" and re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise EncryptedError("encrypted pdf")
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if any(i.flag_bits & 1 for i in z.infolist()) or "META-INF/encryption.xml" in z.namelist():
                raise EncryptedError("encrypted archive")
    if content[:8] == bytes.fromhex("D0CF11E0A1B11AE1") and "EncryptedPackage".encode("utf-16-le") in content:
        raise EncryptedError("encrypted office file")


def laid_out(doc_id: str, parts: Iterator[tuple[str, str, int, bool]]) -> Iterator[dict]:
    """Rows of blocks from (chapter, text, heading level or 0, bold): a chapter begins a page, LINES blocks fill one."""
    page, seq, chapter = 0, 0, None
    for name, text, level, bold in parts:
        if name != chapter or seq == LINES:
            page, seq, chapter = page + 1, 0, name
        y = TOP + STEP * seq
        size = BODY + 2 * (7 - level) * (level > 0)
        yield {"doc_id": doc_id, "page_num": page, "seq": seq, "kind": "text", "x0": LEFT, "y0": y, "x1": RIGHT, "y1": y + 12, "text": text, "font_size": size, "bold": bold}
        seq += 1


class _Blocks(HTMLParser):
    """Headings, paragraphs and list items of XHTML."""

    KEPT = {"p": 0, "li": 0, "blockquote": 0, "td": 0, **{f"h{i}": i for i in range(1, 7)}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, bool]] = []
        self.held: list[str] = []
        self.level, self.bold, self.hidden = 0, False, 0

    def _close(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.found.append((text, self.level, self.bold))
        self.held, self.level, self.bold = [], 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in self.KEPT:
            self._close()
            self.level = self.KEPT[tag]
            if tag == "li":
                self.held.append("- ")
        elif tag in ("b", "strong") and not "".join(self.held).strip():
            self.bold = True
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.KEPT or tag in ("div", "section", "body", "table", "ul", "ol"):
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def html_parts(markup: str) -> list[tuple[str, int, bool]]:
    reader = _Blocks()
    reader.feed(markup)
    reader.close()
    reader._close()
    return reader.found


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Members of an EPUB that hold its text, in reading order."""
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    package = [e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile"][0]
    root = ElementTree.fromstring(z.read(package))
    items = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
    base = posixpath.dirname(package)
    hrefs = [items[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in items]
    return [posixpath.normpath(posixpath.join(base, unquote(h.split("#")[0]))) for h in hrefs]


class NativeProvider:
    """A DocumentProvider for epub, fb2, cbz, pptx and xlsx; other formats give no rows.

    Tables: blocks and pages for texts, image_resources and image_draws for the pages of a CBZ.
    """

    def __init__(self, formats: dict[str, str]):
        """formats: doc_id -> format, as formats.sniffed() finds it."""
        self.formats = formats

    def rows(self, table: str, doc_id: str, content: bytes) -> Iterator[dict]:
        try:
            yield from self._rows(table, doc_id, content)
        except (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, KeyError, IndexError, StopIteration) as e:
            raise ValueError(f"broken document: {e}") from e

    def _rows(self, table: str, doc_id: str, content: bytes) -> Iterator[dict]:
        kind = self.formats.get(doc_id)
        refuse_encrypted(kind, content)
        if kind == "cbz":
            yield from self._comic(table, doc_id, content)
            return
        parts = {"epub": self._epub, "fb2": self._fb2, "pptx": self._slides, "xlsx": self._sheets}.get(kind)
        if parts is None:
            return
        blocks = list(laid_out(doc_id, parts(content)))
        if table == "blocks":
            yield from blocks
        elif table == "pages":
            for page in sorted({b["page_num"] for b in blocks}):
                yield {"doc_id": doc_id, "page_num": page, "is_ocr": False, "width": WIDTH, "height": HEIGHT}

    @staticmethod
    def _epub(content: bytes) -> Iterator[tuple[str, str, int, bool]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            for member in _spine(z):
                if member in names:
                    for text, level, bold in html_parts(z.read(member).decode("utf-8", "replace")):
                        yield member, text, level, bold

    @staticmethod
    def _fb2(content: bytes) -> Iterator[tuple[str, str, int, bool]]:
        root = ElementTree.fromstring(content)

        def walk(node, depth: int, chapter: str) -> Iterator[tuple[str, str, int, bool]]:
            for number, child in enumerate(node):
                tag = _local(child.tag)
                if tag == "section":
                    yield from walk(child, depth + 1, f"{chapter}/{number}" if depth == 0 else chapter)
                elif tag in ("title", "subtitle"):
                    lines = [" ".join("".join(p.itertext()).split()) for p in child] or ["".join(child.itertext())]
                    if text := " ".join(x for x in lines if x):
                        yield chapter, text, min(6, max(1, depth)), False
                elif tag in ("p", "v", "text-author"):
                    if text := " ".join("".join(child.itertext()).split()):
                        yield chapter, text, 0, False
                elif tag not in ("binary", "image"):
                    yield from walk(child, depth, chapter)

        for number, body in enumerate(e for e in root if _local(e.tag) == "body"):
            yield from walk(body, 0, str(number))

    @staticmethod
    def _slides(content: bytes) -> Iterator[tuple[str, str, int, bool]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            slides = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
            for member in sorted(slides, key=lambda n: int(re.search(r"\d+", n)[0])):
                for shape in (e for e in ElementTree.fromstring(z.read(member)).iter() if _local(e.tag) == "sp"):
                    title = any(_local(e.tag) == "ph" and e.get("type") in ("title", "ctrTitle") for e in shape.iter())
                    for paragraph in (e for e in shape.iter() if _local(e.tag) == "p"):
                        if text := "".join(t.text or "" for t in paragraph.iter() if _local(t.tag) == "t").strip():
                            yield member, text, int(title), False

    @staticmethod
    def _sheets(content: bytes) -> Iterator[tuple[str, str, int, bool]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
            sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
            for member in sorted(sheets, key=lambda n: int(re.search(r"\d+", n)[0])):
                for row in (e for e in ElementTree.fromstring(z.read(member)).iter() if _local(e.tag) == "row"):
                    cells = []
                    for cell in row:
                        value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) in ("v", "t"))
                        cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                    if text := "\t".join(cells).strip():
                        yield member, text, 0, False

    @staticmethod
    def _comic(table: str, doc_id: str, content: bytes) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if n.lower().endswith(IMAGES))
            for page, name in enumerate(names, 1):
                data = z.read(name)
                width, height = image_size(data) or (int(WIDTH), int(HEIGHT))
                if table == "pages":
                    yield {"doc_id": doc_id, "page_num": page, "is_ocr": True, "width": float(width), "height": float(height), "ocr_text": ""}
                elif table == "image_resources":
                    yield {"doc_id": doc_id, "page_num": page, "idx": 1, "xref": page, "width": width, "height": height, "ext": posixpath.splitext(name)[1][1:].lower(), "content": data}
                elif table == "image_draws":
                    yield {"doc_id": doc_id, "page_num": page, "draw_seq": 0, "xref": page, "x0": 0.0, "y0": 0.0, "x1": float(width), "y1": float(height)}


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, BMP or JPEG file; None for others and broken ones."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at < len(data):
                while data[at] == 0xFF and data[at + 1] == 0xFF:
                    at += 1
                mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None
