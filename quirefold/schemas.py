"""Explicit schemas of the engine's tables.  Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_BOX = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
_DOC, _PAGE = T.StructField("doc_id", T.StringType()), T.StructField("page_num", T.IntegerType())


def _table(*fields) -> T.StructType:
    out = []
    for f in fields:
        out += f if isinstance(f, list) else [f]
    return T.StructType(out)


def _f(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
OP = T.StructType([_f("op", S), _f("ax", D), _f("ay", D), _f("bx", D), _f("by", D)])

FILES = _table(_DOC, _f("path", S), _f("format", S), _f("content", T.BinaryType()), _f("size", L))
PAGES = _table(_DOC, _PAGE, _f("is_ocr", B), _f("width", D), _f("height", D), _f("ocr_text", S))
BLOCKS = _table(_DOC, _PAGE, _f("seq", I), _f("kind", S), _BOX, _f("text", S), _f("font_size", D), _f("bold", B), _f("xref", I), _f("region_index", I), _f("cells", T.ArrayType(T.ArrayType(S))))
DRAWINGS = _table(_DOC, _PAGE, _f("drawing_id", L), _BOX, _f("ops", T.ArrayType(OP)))
IMAGE_RESOURCES = _table(_DOC, _PAGE, _f("idx", I), _f("xref", I), _f("width", I), _f("height", I), _f("ext", S), _f("content", T.BinaryType()))
IMAGE_DRAWS = _table(_DOC, _PAGE, _f("draw_seq", I), _f("xref", I), _BOX)
TABLE_CANDIDATES = _table(_DOC, _PAGE, _f("table_id", I), _BOX, _f("cells", T.ArrayType(T.ArrayType(S))))
LINKS = _table(_DOC, _PAGE, _f("link_seq", I), _BOX, _f("anchor", S), _f("uri", S))
OCR_WORDS = _table(_DOC, _PAGE, *[_f(c, I) for c in ("block_num", "par_num", "line_num", "word_pos")], _f("text", S), _f("conf", D))
SPANS = _table(_DOC, _PAGE, *[_f(c, I) for c in ("block_seq", "line_no", "span_no")], _f("text", S), _f("size", D), _f("flags", I))
DESCRIPTIONS = _table(_DOC, _f("kind", S), _PAGE, _f("ref", I), _f("text", S), _f("truncated", B))
MODEL_CALLS = _table(_DOC, _f("call_id", I), *[_f(c, L) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], _f("usage_present", B))
CACHE_LOG = _table(_f("ts", D), _f("op", S), _f("key", S), _f("doc_digest", S), _f("kind", S), _f("size", L))
FIGURES = _table(_f("id", S), _f("page", I), _f("kind", S), _f("bbox", T.ArrayType(D)), _f("path", S), _f("description", S), _f("skipped", B))
