import hashlib
import hmac
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.sources import documents, formats, native, store

KEY, BASE = b"k" * 80, "https://host/"


def test_links_hold_for_their_time_only():
    ident = store.new_id()
    assert store.is_id(ident) and not store.is_id("x") and not store.is_id(None) and not store.is_id(ident + "0")
    url = store.link(BASE, KEY, ident, now=1000.5, valid=60)
    assert store.file_of(url, BASE, KEY, 1060) == ident
    assert store.file_of(url, BASE, KEY, 1061) is None and store.file_of(url, BASE, b"other", 1000) is None
    assert store.file_of(url.replace("expires=1060", "expires=9999"), BASE, KEY, 1000) is None
    assert store.file_of(url, "https://elsewhere", KEY, 1000) is None and store.file_of(url + "&x=1", BASE, KEY, 1000) is None


@pytest.mark.parametrize("key", [b"short", b"k" * 64, b"k" * 100])
def test_hmac_in_columns(spark, key):
    got = spark.createDataFrame([("some text é",), ("",)], "t string").select("t", store.hmac_sha256(key, F.col("t")).alias("h")).collect()
    assert all(r.h == hmac.new(key, r.t.encode(), hashlib.sha256).hexdigest() for r in got)


def test_documents_are_resolved_without_fetching(spark):
    a, b = store.new_id(), store.new_id()
    files = spark.createDataFrame([(a, bytearray(b"one"))], "file_id string, content binary")
    rows = [
        (1, a, None), (2, b, None), (3, None, store.link(BASE, KEY, a, 1000)), (4, None, store.link(BASE, KEY, a, 1000, valid=5)), (5, None, store.link(BASE, b"forged", a, 1000)),
        (6, None, "data:text/plain;base64,dHdv"), (7, None, "data:text/plain;base64,%%%"), (8, None, "http://169.254.0.1/secret"), (9, None, "file:///etc/passwd"), (10, "../x", None), (11, None, None),
    ]
    asked = spark.createDataFrame(rows, "request_id int, file_id string, url string")
    got = {r.request_id: (r.content and bytes(r.content), r.refusal) for r in store.resolved(asked, files, BASE, KEY, F.lit(1100)).collect()}
    no = (None, "unsupported")
    assert got == {1: (b"one", None), 2: (None, "not_found"), 3: (b"one", None), 4: (None, "expired"), 5: no, 6: (b"two", None), 7: no, 8: no, 9: no, 10: no, 11: no}


def test_multipart():
    body = b'--XX\r\nContent-Disposition: form-data; name="file"; filename="a b.pdf"\r\nContent-Type: x/y\r\n\r\n%PDF\r\n--not\r\n--XX\r\nContent-Disposition: form-data; name="mode"\r\n\r\nboth\r\n--XX--\r\n'
    assert store.multipart(body, 'multipart/form-data; boundary="XX"', 1000) == {"file": ("a b.pdf", b"%PDF\r\n--not"), "mode": (None, b"both")}
    with pytest.raises(ValueError):
        store.multipart(body, "multipart/form-data; boundary=XX", 10)
    with pytest.raises(ValueError):
        store.multipart(body, "multipart/form-data", 1000)


def zipped(members, **kinds):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


EPUB = zipped({
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container xmlns="u"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
    "OPS/book.opf": '<package xmlns="o"><manifest><item id="b" href="two%20b.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/></spine></package>',
    "OPS/one.xhtml": "<html><head><title>no</title></head><body><h1>First &amp; best</h1><p>Some <i>words</i>\n here.</p><ul><li>an item</li></ul><script>x</script></body></html>",
    "OPS/two b.xhtml": "<html><body><h2>Second</h2><p><b>Bold</b> text</p><p> </p></body></html>",
})
FB2 = "<?xml version='1.0'?><FictionBook xmlns='f'><description><title-info/></description><body><title><p>The</p><p>Title</p></title><section><title><p>Part</p></title><p>Text é one.</p><section><p>Deeper</p></section></section></body><binary id='x'>AAAA</binary></FictionBook>".encode()
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
PPTX = zipped({"ppt/slides/slide2.xml": "<s xmlns='a'><sp><p><t>Two</t></p></sp></s>", "ppt/slides/slide10.xml": "<s xmlns='a'><sp><p><t>Ten</t></p></sp></s>", "ppt/slides/slide1.xml": "<s xmlns='a'><sp><ph type='title'/><p><t>Head</t><t>line</t></p></sp></s>"})
XLSX = zipped({"xl/sharedStrings.xml": "<sst xmlns='a'><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": "<w xmlns='a'><sheetData><row><c t='s'><v>0</v></c><c><v>12</v></c></row><row/></sheetData></w>"})


def test_native_formats(spark):
    held = {"e": EPUB, "f": FB2, "c": zipped({"b.png": PNG, "a.PNG": PNG}), "p": PPTX, "x": XLSX, "broken": EPUB[:100], "other": b"%PDF-1.7"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "doc_id string, content binary")
    kinds = {r.doc_id: r.found for r in formats.sniffed(files).collect()}
    assert kinds == {"e": "epub", "f": "fb2", "c": "cbz", "p": "pptx", "x": "xlsx", "broken": None, "other": "pdf"}
    provider = native.NativeProvider({**kinds, "broken": "epub"})
    rows = documents.provided(files, provider, "blocks", schemas.BLOCKS).orderBy("doc_id", "page_num", "seq").collect()
    told = lambda doc: [(r.page_num, r.text, r.font_size, r.bold) for r in rows if r.doc_id == doc]
    assert told("e") == [(1, "First & best", 22.0, False), (1, "Some words here.", 10.0, False), (1, "- an item", 10.0, False), (2, "Second", 20.0, False), (2, "Bold text", 10.0, True)]
    assert told("f") == [(1, "The Title", 22.0, False), (2, "Part", 22.0, False), (2, "Text é one.", 10.0, False), (2, "Deeper", 10.0, False)]
    assert told("p") == [(1, "Headline", 22.0, False), (2, "Two", 10.0, False), (3, "Ten", 10.0, False)]
    assert told("x") == [(1, "name\t12", 10.0, False)] and not told("broken") and not told("other")
    pages = documents.provided(files, provider, "pages", schemas.PAGES).where("doc_id = 'c'").orderBy("page_num").collect()
    assert [(p.page_num, p.is_ocr, p.width, p.height) for p in pages] == [(1, True, 640.0, 480.0), (2, True, 640.0, 480.0)]
    images = documents.provided(files, provider, "image_resources", schemas.IMAGE_RESOURCES).collect()
    assert len(images) == 2 and all((i.width, i.height, i.ext) == (640, 480, "png") for i in images)
    assert documents.provided(files, provider, "image_draws", schemas.IMAGE_DRAWS).count() == 2


def test_locked_documents_are_refused():
    locked = bytearray(zipped({"a.txt": "x"}))
    locked[6] |= 1  # the flag in the member's own head
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    for kind, content in (("pdf", b"%PDF-1.7 trailer << /Encrypt 5 0 R >>"), ("cbz", bytes(locked)), ("epub", zipped({"META-INF/encryption.xml": "x"})), ("ole", bytes.fromhex("D0CF11E0A1B11AE1") + "EncryptedPackage".encode("utf-16-le"))):
        with pytest.raises(native.EncryptedError):
            native.refuse_encrypted(kind, content)
    native.refuse_encrypted("pdf", b"%PDF-1.7 /Encrypt is a word")
    native.refuse_encrypted("epub", EPUB)


def test_image_sizes():
    assert native.image_size(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert native.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    assert native.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40)) == (40, 30)
    assert native.image_size(b"\xff\xd8\xff") is None and native.image_size(b"") is None
