"""The registered queries as SQL for DuckDB over the same tables."""

from __future__ import annotations


def _blocks(two_columns: bool = False) -> str:
    x0 = "72.0 + 250.0 * (nr % 2)" if two_columns else "72.0"
    return f"""
lines AS (
  SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS nr
  FROM documents),
blocks AS (
  SELECT doc_id, (nr // 12 + 1)::INTEGER AS page_num, (nr % 12)::INTEGER AS seq, text, ({x0})::DOUBLE AS x0,
    (40.0 + 60.0 * (nr % 12))::DOUBLE AS y0, least(540.0, {x0} + 5.0 * length(text))::DOUBLE AS x1, (52.0 + 60.0 * (nr % 12))::DOUBLE AS y1,
    CASE WHEN nr = 0 AND len(regexp_split_to_array(trim(text), ' +')) <= 18 THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size
  FROM lines WHERE trim(text) <> ''),
sheets AS (SELECT DISTINCT doc_id, page_num FROM blocks)"""


_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_STRIP = rf"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
_SQUEEZE = rf"trim(regexp_replace(%s, '{_WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return _STRIP % c


def squeeze(c: str) -> str:
    return _SQUEEZE % c


def words(c: str) -> str:
    return f"list_filter(string_split({squeeze(c)}, ' '), lambda w: w <> '')"


_LEVELS = f"""
sized AS (SELECT doc_id, font_size, sum(length(text)) AS chars, min(page_num * 1000 + seq) AS first FROM blocks GROUP BY ALL),
bodies AS (SELECT doc_id, font_size AS body FROM sized QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1),
candidates AS (
  SELECT b.*, body, (len({words('text')}) <= 18 AND length(text) - length(replace(text, chr(10), '')) < 3 AND x1 - x0 >= y1 - y0 AND font_size > body) AS heading
  FROM blocks b JOIN bodies USING (doc_id)),
leveled AS (
  SELECT *, CASE WHEN heading THEN least(6, dense_rank() OVER (PARTITION BY doc_id, heading ORDER BY font_size DESC))::INTEGER END AS level FROM candidates)"""

_FIRST_LINE = f"regexp_split_to_array({strip('%s')}, '\\r\\n|[\\n\\x0B\\f\\r]')[1]"


def list_item(c: str) -> str:
    bullets = r"[•▪◦‣·–\-*]"
    first = _FIRST_LINE.replace("%s", c)
    return f"CASE WHEN regexp_matches({first}, '^{bullets}{_WS}+') THEN '- ' || regexp_replace({squeeze(c)}, '^{bullets} ', '') END"


_RENDERED = f"CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' || {squeeze('text')} ELSE coalesce({list_item('text')}, {strip('text')}) END"

_MARKDOWN = f"""
parts AS (
  SELECT doc_id, page_num, seq, {_RENDERED} AS part FROM leveled WHERE {strip('text')} <> ''
  UNION ALL SELECT doc_id, page_num, -1, '<!-- page ' || page_num || ' -->' FROM sheets),
marked AS (
  SELECT doc_id, {strip("string_agg(part, chr(10) || chr(10) ORDER BY page_num, seq)")} || chr(10) AS markdown FROM parts WHERE part <> '' GROUP BY doc_id)"""

_PAGES = rf"""
found AS (SELECT doc_id, markdown, regexp_extract_all(markdown, '<!-- page (\d+) -->', 1) AS numbers, regexp_split_to_array(markdown, '<!-- page \d+ -->') AS texts FROM marked),
split AS (SELECT doc_id, unnest(range(len(numbers)))::INTEGER AS pos, unnest(numbers)::INTEGER - 1 AS "index", unnest(texts[2:]) AS body FROM found),
cut AS (SELECT doc_id, pos, "index", {strip('body')} AS markdown FROM split)"""

_HF = """
framed AS (
  SELECT doc_id, page_num, seq, text, y0, y1 FROM blocks
  UNION ALL SELECT s.doc_id, page_num, 100, 'Source ' || source, 20.0, 32.0 FROM sheets s JOIN documents d ON d.doc_id::VARCHAR = s.doc_id
  UNION ALL SELECT doc_id, page_num, 101, page_num::VARCHAR, 772.0, 784.0 FROM sheets)"""

_RUNNING = rf"""
counted AS (SELECT doc_id, greatest(3, round_even(0.5 * count(*), 0)::INTEGER) AS needed FROM sheets GROUP BY doc_id HAVING count(*) >= 4),
margin AS (SELECT *, {squeeze('lower(text)')} AS line FROM framed WHERE y0 < 0.12 * 792.0 OR y1 > (1 - 0.12) * 792.0),
often AS (SELECT doc_id, line, count(DISTINCT page_num) AS on_pages FROM margin GROUP BY ALL),
running AS (
  SELECT doc_id, page_num, seq FROM margin JOIN counted USING (doc_id) JOIN often USING (doc_id, line)
  WHERE on_pages >= needed OR regexp_matches(regexp_replace(text, '^(?:{_WS}|[-–—])+|(?:{_WS}|[-–—])+$', '', 'g'), '(?i)^(page\s+)?\d{{1,4}}(\s*/\s*\d{{1,4}}|\s+of\s+\d{{1,4}})?$'))"""

_CANDIDATES = r"""
cells AS (
  SELECT s_nationkey AS table_id, s_suppkey, s_name AS a, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS b,
    CASE WHEN s_nationkey % 3 = 0 THEN 'n/a' ELSE 'number' END AS c FROM supplier),
kept AS (
  SELECT table_id, count(*) AS n_rows, 3 AS n_cols, count(*) FILTER (b <> '') AS b_filled, count(*) FILTER (c = 'number') AS c_numbers,
    count(*) * 2 + count(*) FILTER (b <> '') AS filled
  FROM cells GROUP BY table_id),
placed AS (
  SELECT *, (table_id % 4)::INTEGER AS page_num, table_id * 10.0 AS x0, table_id * 20.0 AS y0, table_id * 10.0 + 100 AS x1, table_id * 20.0 + 50 AS y1 FROM kept),
regions AS (
  SELECT n_nationkey::INTEGER AS region_index, (n_nationkey % 4)::INTEGER AS page_num, n_nationkey * 11.0 AS x0, n_nationkey * 19.0 AS y0, n_nationkey * 11.0 + 80 AS x1, n_nationkey * 19.0 + 60 AS y1
  FROM nation WHERE n_nationkey % 2 = 0),
over_region AS (
  SELECT DISTINCT table_id FROM placed t JOIN regions g USING (page_num)
  WHERE greatest(0, least(t.x1, g.x1) - greatest(t.x0, g.x0)) * greatest(0, least(t.y1, g.y1) - greatest(t.y0, g.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) > 0.5),
judged AS (
  SELECT *, (CASE WHEN b_filled >= 2 THEN 1 ELSE 0 END + CASE WHEN n_rows >= 2 AND c_numbers > 0 THEN 1 ELSE 0 END) AS numeric,
    (CASE WHEN n_rows >= 2 THEN 1 ELSE 0 END + CASE WHEN n_rows >= 2 AND c_numbers = 0 THEN 1 ELSE 0 END) AS label,
    table_id IN (SELECT table_id FROM over_region) AS over_figure FROM placed)"""


def _boxes(doc: str, page: str, kind: str = "part", key: str = "p_partkey") -> str:
    return f"""
boxes AS (
  SELECT {doc} AS doc_id, {page} AS page_num, {key}::BIGINT AS drawing_id, ({key} * 37 % 500)::DOUBLE AS x0, ({key} * 91 % 700)::DOUBLE AS y0,
    ({key} * 37 % 500 + {key} % 29 + 1)::DOUBLE AS x1, ({key} * 91 % 700 + {key} % 23 + 1)::DOUBLE AS y1 FROM {kind})"""


def _close(slack: float) -> str:
    return f"a.x1 + {slack} >= b.x0 AND b.x1 + {slack} >= a.x0 AND a.y1 + {slack} >= b.y0 AND b.y1 + {slack} >= a.y0"


_LOG = """
log AS (
  SELECT (user_id % 10)::VARCHAR AS store, event_id AS seq, floor(epoch(ts)) AS ts, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op,
    'k' || (event_id % 17) AS k, 'd' || (user_id % 7) AS doc_digest, CASE WHEN user_id % 2 = 0 THEN 'document' ELSE 'description' END AS kind, 50 + event_id % 100 AS size
  FROM events)"""

_ENTRIES = (
    _LOG
    + """,
entries AS (
  SELECT store || '/' || k AS key, store, max(ts) AS last_accessed, min(ts) FILTER (op = 'put') AS created,
    first(doc_digest ORDER BY ts, seq) FILTER (op = 'put') AS doc_digest, first(kind ORDER BY ts, seq) FILTER (op = 'put') AS kind,
    last(size ORDER BY ts, seq) FILTER (op = 'put') AS size
  FROM log GROUP BY store, k HAVING created IS NOT NULL)"""
)

_CAPTIONS = """
items AS (SELECT *, l_orderkey % 500 AS doc_id, month(l_shipdate) AS page_num FROM lineitem),
captions AS (SELECT DISTINCT doc_id, l_linenumber AS number, page_num FROM items)"""

_EMPTY_GAP = """
moments AS (SELECT user_id, event_id, floor(epoch(ts)) / 60 AS y0, floor(epoch(ts)) / 60 + event_id % 300 AS y1 FROM events),
gaps AS (SELECT *, y0 - max(y1) OVER (PARTITION BY user_id ORDER BY y0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 600 AS starts FROM moments)"""


_REGIONS = f"""
d AS (SELECT (l_orderkey // 2000)::VARCHAR AS doc_id, (l_orderkey // 40 % 50)::INTEGER AS page_num, l_orderkey * 8 + l_linenumber AS id, (l_partkey * 13 % 180)::DOUBLE + 40 AS x0,
  (l_suppkey * 7 % 120)::DOUBLE + CASE WHEN l_orderkey % 2 = 0 THEN 60.0 ELSE 420.0 END AS y0, l_partkey % 6 AS tall FROM lineitem),
b AS (SELECT *, x0 + 9 AS x1, y0 + 1 + tall AS y1, count(*) OVER (PARTITION BY doc_id, page_num) AS on_page FROM d),
u AS (SELECT * FROM b WHERE on_page >= 30 AND NOT (x1 - x0 < 2 AND y1 - y0 < 2) AND (x1 - x0) * (y1 - y0) <= 0.4 * 612.0 * 792.0),
near AS (SELECT a.doc_id, a.page_num, a.id AS a, b.id AS b FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND {_close(3.0)}),
reach AS (SELECT doc_id, page_num, a, b FROM near UNION SELECT r.doc_id, r.page_num, r.a, n.b FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.page_num = r.page_num AND n.a = r.b),
heaps AS (SELECT doc_id, page_num, a AS id, min(b) AS heap FROM reach GROUP BY ALL),
sized AS (SELECT u.*, heap, count(*) OVER (PARTITION BY doc_id, page_num, heap) AS members FROM u JOIN heaps USING (doc_id, page_num, id)),
gaps AS (SELECT *, y0 - max(y1) OVER (PARTITION BY doc_id, page_num, heap ORDER BY y0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 40 AS starts FROM sized WHERE members >= 8),
parts AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, heap ORDER BY y0, id ROWS UNBOUNDED PRECEDING) AS part FROM gaps),
raw AS (SELECT doc_id, page_num, heap, part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*)::INTEGER AS n, count(*) FILTER (x1 - x0 >= 2 AND y1 - y0 >= 2) AS solid FROM parts GROUP BY ALL),
padded AS (
  SELECT doc_id, page_num, heap, part, n, greatest(x0 - 6, 0.0) AS x0, greatest(y0 - 6, 0.0) AS y0, least(x1 + 6, 612.0) AS x1, least(y1 + 6, 792.0) AS y1
  FROM raw WHERE n >= 8 AND solid >= 4 AND x1 - x0 >= 80 AND y1 - y0 >= 60),
limits AS (
  SELECT a.doc_id, a.page_num, a.heap, a.part, a.n, a.x0, a.y0, a.x1, a.y1,
    greatest(0.0, coalesce(max(CASE WHEN b.y1 <= a.y0 THEN b.y1 + 4 END), 0.0)) AS y_min, least(792.0, coalesce(min(CASE WHEN NOT b.y1 <= a.y0 AND b.y0 >= a.y1 THEN b.y0 - 4 END), 792.0)) AS y_max
  FROM padded a LEFT JOIN padded b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND (a.heap, a.part) <> (b.heap, b.part)
    AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) GROUP BY ALL),
joined AS (
  SELECT *, least(x1, 150.0) - greatest(x0, 50.0) >= 0.3 * 100 AND ((40 <= y0 AND y0 - 40 <= 30 AND 20 >= y_min) OR (20 >= y1 AND 20 - y1 <= 30 AND 40 <= y_max)) AS titled FROM limits),
grown AS (
  SELECT doc_id, page_num, n, CASE WHEN titled THEN least(x0, 50.0) ELSE x0 END AS x0, CASE WHEN titled THEN least(y0, 20.0) ELSE y0 END AS y0,
    CASE WHEN titled THEN greatest(x1, 150.0) ELSE x1 END AS x1, CASE WHEN titled THEN greatest(y1, 40.0) ELSE y1 END AS y1 FROM joined)"""

#: One store's entries as a list in order of their stamps, an operation a step.
_REPLAY = """
steps AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY ts, seq) AS n FROM log),
run AS (
  SELECT store, 0::BIGINT AS n, [{'k': '', 't': 0.0::DOUBLE, 's': 0::BIGINT}][1:0] AS held, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 0 AS expirations, 0 AS evictions FROM (SELECT DISTINCT store FROM log)
  UNION ALL
  SELECT store, n, CASE WHEN op = 'put' THEN young[first_kept:] WHEN one IS NULL THEN held WHEN ts - one.t > 86400.0 THEN rest WHEN ts - one.t > 864.0 THEN list_append(rest, {'k': k, 't': ts, 's': one.s}) ELSE held END, seq,
    CASE WHEN op = 'put' THEN 'stored' WHEN one IS NULL OR ts - one.t > 86400.0 THEN 'miss' ELSE 'hit' END,
    CASE WHEN op = 'put' THEN (len(rest) + 1 - len(young))::INTEGER WHEN one IS NOT NULL AND ts - one.t > 86400.0 THEN 1 ELSE 0 END, CASE WHEN op = 'put' THEN (first_kept - 1)::INTEGER ELSE 0 END
  FROM (
    SELECT *, list_min(list_filter(range(1, len(young) + 2), lambda i: coalesce(list_sum(list_transform(young[i:], lambda x: x.s)), 0) <= 1200)) AS first_kept
    FROM (
      SELECT *, list_filter(list_append(rest, {'k': k, 't': ts, 's': size}), lambda x: ts - x.t <= 86400.0) AS young
      FROM (
        SELECT l.store, l.n, l.seq, l.op, l.ts, l.k, l.size::BIGINT AS size, r.held, list_filter(r.held, lambda x: x.k <> l.k) AS rest, list_filter(r.held, lambda x: x.k = l.k)[1] AS one
        FROM run r JOIN steps l ON l.store = r.store AND l.n = r.n + 1))))"""

_HTML = r"""
bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS html FROM pages),
cut AS (SELECT page_id, string_split(regexp_replace(html, '(?i)<(h[1-6]|p|li|/p|/li|/h[1-6]|/ul|/ol|/article|/nav|/body|/div)\b', chr(1) || '<\1', 'g'), chr(1)) AS pieces FROM bare),
each_piece AS (SELECT page_id, unnest(range(2, len(pieces))) AS i, unnest(pieces[2:len(pieces) - 1]) AS piece FROM cut),
opened AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, lower(regexp_extract(piece, '(?is)^<(h[1-6]|p|li)\b[^>]*>', 1)) AS tag, regexp_replace(piece, '(?is)^<(h[1-6]|p|li)\b[^>]*>', '') AS body
  FROM each_piece WHERE regexp_matches(piece, '(?is)^<(h[1-6]|p|li)\b[^>]*>')),
texts AS (
  SELECT page_id, pos::INTEGER AS pos, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM opened)"""

_FLIGHTS = """
led AS (SELECT event_id AS request_id, first(event_id) OVER w AS leader FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id))"""

_GRID = """
marks AS (SELECT (p_size % 4)::INTEGER AS page_num, p_partkey AS drawing_id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 91 % 700)::DOUBLE AS y0,
  (p_partkey * 37 % 500 + p_partkey % 29 + 1)::DOUBLE AS x1, (p_partkey * 91 % 700 + p_partkey % 23 + 1)::DOUBLE AS y1 FROM part)"""


def _common(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _fingerprint(prompt: str) -> str:
    parts = ("m", "u", prompt, "auto", "None", "False", "0", "0", "300")
    return f"sha256({' || chr(31) || '.join(repr(p) for p in parts)})[1:16]"


def oracle_sql() -> dict[str, str]:
    return {
        "doc_stats_scan_hint": f"""WITH {_blocks()}, texts AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS text FROM blocks GROUP BY ALL)
SELECT doc_id, count(*) AS pages, avg(length({strip('text')})) AS avg_chars, avg(length({strip('text')})) < 50 AS looks_scanned FROM texts GROUP BY doc_id""",
        "garble_ratio_by_doc": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(65533) || chr(57345) || chr(1) ELSE text END AS text FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{FFFD}\p{Co}\p{Cf}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) / length(text) AS garbled FROM t)
SELECT doc_id, garbled, garbled >= 0.001 AS warn FROM c""",
        "column_boundaries": f"""WITH {_blocks(True)}, e AS (
  SELECT doc_id, page_num, x0, lag(x0) OVER w AS prev, row_number() OVER w - 1 AS before, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY x0))
SELECT doc_id, page_num, (prev + x0) / 2 AS cut FROM e WHERE x0 - prev >= 0.06 * 612.0 AND n >= 4 AND before BETWEEN 2 AND n - 2""",
        "reading_order_two_column": f"""WITH {_blocks(True)}, e AS (
  SELECT *, lag(x0) OVER w AS prev, row_number() OVER w - 1 AS before, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY x0)),
cuts AS (SELECT doc_id, page_num, (prev + x0) / 2 AS cut FROM e WHERE x0 - prev >= 0.06 * 612.0 AND n >= 4 AND before BETWEEN 2 AND n - 2),
placed AS (SELECT b.*, (SELECT count(*) FROM cuts c WHERE c.doc_id = b.doc_id AND c.page_num = b.page_num AND b.x0 >= c.cut)::INTEGER AS col FROM blocks b)
SELECT doc_id, page_num, seq, col, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY col, round_even(y0 / 10, 0), x0, seq)::INTEGER AS pos FROM placed""",
        "page_ocr_decision": f"""WITH {_blocks()}, texts AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY seq) AS text FROM blocks GROUP BY ALL),
c AS (SELECT t.doc_id, t.page_num, length({strip('t.text')})::INTEGER AS chars, coalesce(least(1.0, 612.0 * length(b.text) * 8.0 / (612.0 * 792.0)), 0.0) AS coverage
  FROM texts t LEFT JOIN blocks b ON b.doc_id = t.doc_id AND b.page_num = t.page_num AND b.seq = 0)
SELECT doc_id, page_num, chars, round(coverage, 9) AS coverage, chars < 50 AND coverage >= 0.5 AS needs_ocr FROM c""",
        "body_font_mode": f"WITH {_blocks()}, {_LEVELS} SELECT doc_id, body FROM bodies",
        "heading_levels": f"WITH {_blocks()}, {_LEVELS} SELECT doc_id, page_num, seq, level FROM leveled WHERE level IS NOT NULL",
        "span_join_dominant_font": """WITH s AS (SELECT o_custkey AS block_seq, o_orderkey % 3 AS line_no, o_orderkey AS span_no, o_orderstatus || o_orderpriority AS text, o_totalprice / 4 AS size, (o_orderkey % 32)::INTEGER AS flags FROM orders),
lines AS (SELECT block_seq, line_no, string_agg(text, '' ORDER BY span_no) AS line FROM s GROUP BY ALL),
main AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY block_seq ORDER BY length(text) DESC, line_no, span_no) = 1)
SELECT block_seq, any_value(m.b) AS bold, any_value(m.fs) AS font_size, string_agg(line, chr(10) ORDER BY line_no) AS text
FROM lines JOIN (SELECT block_seq, round_even(size, 1)::DOUBLE AS fs, (flags & 16) <> 0 AS b FROM main) m USING (block_seq) GROUP BY block_seq""",
        "list_items": f"""WITH {_blocks()}, t AS (SELECT doc_id, page_num, seq, CASE WHEN seq % 3 = 0 THEN ['•', '–', '*', '-'][seq % 4 + 1] || '  ' || text ELSE text END AS text FROM blocks)
SELECT * FROM (SELECT doc_id, page_num, seq, {list_item('text')} AS item FROM t) WHERE item IS NOT NULL""",
        "running_lines_boilerplate": f"WITH {_blocks()}, {_HF}, {_RUNNING} SELECT * FROM running",
        "boilerplate_stripped_counts": f"""WITH {_blocks()}, {_HF}, {_RUNNING}
SELECT doc_id, count(*) AS blocks_left FROM framed f WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = f.doc_id AND r.page_num = f.page_num AND r.seq = f.seq) GROUP BY doc_id""",
        "doc_markdown": f"WITH {_blocks()}, {_LEVELS}, {_MARKDOWN} SELECT * FROM marked",
        "raw_text_pages": f"""WITH {_blocks()}, texts AS (SELECT doc_id, page_num, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM blocks GROUP BY ALL),
headed AS (SELECT doc_id, string_agg(chr(10) || chr(10) || '--- Page ' || page_num || ' ---' || chr(10) || chr(10) || text, '' ORDER BY page_num) AS whole FROM texts GROUP BY doc_id)
SELECT doc_id, {strip('whole')} || chr(10) AS raw_text FROM headed""",
        "split_pages": f"WITH {_blocks()}, {_LEVELS}, {_MARKDOWN}, {_PAGES} SELECT * FROM cut",
        "page_select": f"""WITH {_blocks()}, {_LEVELS}, {_MARKDOWN}, {_PAGES},
asked AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 0)) v(item, nth, "index"))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY item, nth)::INTEGER AS pos, "index", length(markdown) AS chars FROM cut JOIN asked USING ("index")""",
        "pages_out_of_range": f"""WITH {_blocks()}, counts AS (SELECT doc_id, count(*) AS n FROM sheets GROUP BY doc_id)
SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS missing FROM counts, (VALUES (1), (2), (3)) v(i) WHERE i >= n GROUP BY doc_id""",
        "markdown_table": """WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN [o_orderpriority, o_orderstatus] ELSE [o_orderpriority, o_orderstatus || '\\|x', o_orderkey::VARCHAR] END AS row FROM orders),
w AS (SELECT *, max(len(row)) OVER (PARTITION BY o_custkey) AS width, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM r),
l AS (SELECT o_custkey, n, width, '| ' || array_to_string(list_concat(row, list_resize([]::VARCHAR[], width - len(row), '')), ' | ') || ' |' AS line FROM w)
SELECT o_custkey, string_agg(CASE WHEN n = 1 THEN line || chr(10) || '| ' || array_to_string(list_resize([]::VARCHAR[], width, '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY n) AS markdown FROM l GROUP BY o_custkey""",
        "blockquotes": f"""SELECT conv_id, turn, array_to_string(list_transform(string_split({strip('text')}, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '>' ELSE '> ' || x END), chr(10)) AS quote FROM conversations""",
        "table_keep_gates": f"""WITH {_CANDIDATES} SELECT table_id, n_rows::INTEGER AS n_rows, n_cols, numeric::BIGINT AS numeric, label::BIGINT AS label, over_figure,
  n_rows >= 3 AND NOT over_figure AND numeric >= 2 AND label >= 1 AS keep FROM judged""",
        "table_probe": f"""WITH {_CANDIDATES} SELECT CASE WHEN n_rows < 3 THEN 'tiny' WHEN filled / (3.0 * n_rows) < 0.6 THEN 'empty' WHEN over_figure THEN 'on_diagram' ELSE 'good' END AS fault, count(*) AS n FROM judged GROUP BY ALL""",
        "text_in_table_anti": f"""WITH {_boxes("'d'", "(p_size % 4)::INTEGER")}, {_CANDIDATES}
SELECT page_num, drawing_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM placed t WHERE t.page_num = b.page_num
  AND greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) * greatest(0, least(t.y1, b.y1) - greatest(t.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5)""",
        "rect_proximity_join": f"""WITH {_boxes("p_brand", "1")} SELECT a.doc_id, a.page_num, a.drawing_id AS a, b.drawing_id AS b FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.drawing_id < b.drawing_id AND {_close(3.0)}""",
        "rect_components": f"""WITH RECURSIVE {_boxes("p_brand", "1")}, near AS (SELECT a.doc_id, a.drawing_id AS a, b.drawing_id AS b FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND {_close(12.0)}),
reach AS (SELECT doc_id, a, b FROM near UNION SELECT r.doc_id, r.a, n.b FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.a = r.b)
SELECT doc_id, 1 AS page_num, a AS drawing_id, min(b) AS cluster FROM reach GROUP BY doc_id, a""",
        "y_gap_split": f"""WITH {_EMPTY_GAP} SELECT user_id, event_id, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y0, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS part FROM gaps""",
        "region_neighbour_limits": f"""WITH {_CANDIDATES}, n AS (
  SELECT a.region_index, a.y0, a.y1, max(CASE WHEN b.y1 <= a.y0 THEN b.y1 + 4 END) AS lo, min(CASE WHEN NOT b.y1 <= a.y0 AND b.y0 >= a.y1 THEN b.y0 - 4 END) AS hi
  FROM regions a LEFT JOIN regions b ON a.page_num = b.page_num AND a.region_index <> b.region_index AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) GROUP BY ALL)
SELECT region_index, greatest(0.0, coalesce(lo, 0.0))::DOUBLE AS y_min, least(400.0, coalesce(hi, 400.0))::DOUBLE AS y_max FROM n""",
        "text_in_region_anti": f"""WITH {_boxes("'d'", "(p_size % 4)::INTEGER")}, {_CANDIDATES}
SELECT page_num, drawing_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM regions t WHERE t.page_num = b.page_num
  AND greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) * greatest(0, least(t.y1, b.y1) - greatest(t.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.8)""",
        "context_words": f"""WITH {_blocks()}, w AS (SELECT doc_id, page_num, seq, {words('text')} AS ws FROM blocks),
c AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY page_num, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM w),
alls AS (SELECT doc_id, flatten(list(ws ORDER BY page_num, seq)) AS ws FROM w GROUP BY doc_id),
f AS (SELECT doc_id, page_num, seq AS fig, prior, len(c.ws) AS own FROM c WHERE (page_num * 12 + seq) % 10 = 3)
SELECT doc_id, page_num, fig, array_to_string(a.ws[greatest(1, prior - 19):prior], ' ') AS before, array_to_string(a.ws[prior + own + 1:prior + own + 20], ' ') AS after FROM f JOIN alls a USING (doc_id)""",
        "leading_sample": f"""WITH {_blocks()}, w AS (SELECT doc_id, flatten(list({words('text')} ORDER BY page_num, seq)) AS ws FROM blocks GROUP BY doc_id) SELECT doc_id, array_to_string(ws[1:120], ' ') AS sample FROM w""",
        "image_filter_reasons": """WITH d AS (SELECT l_partkey AS xref, arg_min(l_quantity * 12, l_orderkey * 8 + l_linenumber) AS x1 FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL),
j AS (SELECT CASE WHEN x1 IS NULL THEN 'not_drawn' WHEN p_size * 4 < 50 OR p_partkey % 200 < 50 THEN 'small' WHEN p_partkey % 100 % 2 = 0 AND x1 * 790.0 / (612.0 * 792.0) > 0.80 THEN 'full_page' ELSE 'kept' END AS reason FROM part LEFT JOIN d ON xref = p_partkey)
SELECT reason, count(*) AS n FROM j GROUP BY ALL""",
        "figure_manifest": """WITH i AS (
  SELECT printf('page-%03d-img-%02d', p_size, p_partkey) AS id, p_size::INTEGER AS page, 'image' AS kind, CASE WHEN p_partkey % 2 = 0 THEN '1,2,3,4' END AS box, p_partkey AS k, p_name AS name FROM part
  UNION ALL SELECT printf('page-%03d-diagram-%02d', s_suppkey % 50 + 1, s_suppkey), (s_suppkey % 50 + 1)::INTEGER, 'diagram', '5,6,7,8', s_suppkey, s_name FROM supplier)
SELECT id, page, kind, box, kind || 's/' || id || '.png' AS path, CASE WHEN k % 5 = 0 THEN '' ELSE name END AS description, k % 5 = 0 AS skipped FROM i WHERE k % 7 <> 0""",
        "figure_counts_skip": """SELECT doc_id % 10 AS doc_id, count(*) FILTER (quality <> 0) AS figure_count, count(*) FILTER (quality = 0 AND toxic <> 1) AS skipped_count FROM labels GROUP BY ALL""",
        "image_dedup_jobs": """SELECT min(doc_id) AS idx, sha256(text)[1:32] || '-' || sha256('m' || chr(31) || 'p')[1:10] AS key FROM documents WHERE text IS NOT NULL GROUP BY text""",
        "cache_hit_miss": """SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS hit FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL""",
        "prompts_and_keys": f"""WITH p AS (SELECT conv_id, turn, role, concat_ws(chr(10) || chr(10), CASE WHEN conv_id % 3 = 0 THEN '[Document type]' || chr(10) || 'talk ' || conv_id END,
  CASE WHEN text <> '' THEN '[Text context before the image]' || chr(10) || array_to_string({words('text')}[-5:], ' ') END) AS around,
  'Describe.' || chr(10) || chr(10) || 'If the figure is only decoration, a logo or an ornament, answer with [SKIP] alone.' || chr(10) || chr(10) ||
  CASE WHEN turn % 2 = 0 THEN 'Answer in the language of the document''s text and context above; do not translate.' ELSE 'Answer in French.' END AS task FROM conversations),
q AS (SELECT conv_id, turn, role, CASE WHEN around = '' THEN task ELSE around || chr(10) || chr(10) || '[Task]' || chr(10) || task END AS prompt FROM p)
SELECT conv_id, turn, prompt, sha256(prompt || chr(31) || role)[1:10] AS key FROM q""",
        "model_descriptions": """WITH k AS (SELECT doc_id, sha256(text)[1:32] AS d FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN d[32] = '0' THEN '[SKIP]' ELSE 'image ' || d END AS text, d[32] = 'f' AS truncated FROM k""",
        "usage_cost": """WITH c AS (SELECT conv_id AS doc_id, turn, role <> 'system' AS present, len(string_split(text, ' ')) AS n FROM conversations),
s AS (SELECT doc_id, coalesce(sum(n) FILTER (present), 0)::BIGINT AS prompt_tokens, coalesce(sum(n % 7) FILTER (present), 0)::BIGINT AS completion_tokens,
  coalesce(sum(CASE WHEN turn % 2 = 0 THEN n + n % 7 ELSE n * 2 END) FILTER (present), 0)::BIGINT AS total_tokens, count(*) AS api_calls, count(*) FILTER (NOT present) AS calls_missing_usage FROM c GROUP BY doc_id)
SELECT *, (prompt_tokens * 0.00000025 + completion_tokens * 0.0000005)::DECIMAL(18,8)::DOUBLE AS estimated_cost FROM s""",
        "single_flight": """SELECT event_id AS request_id, first(event_id) OVER w AS leader, first(event_id) OVER w = event_id AS leads FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id)""",
        "cache_stats": f"""WITH {_LOG} SELECT kind, count(*) FILTER (op = 'get' AND seq % 5 <> 0) AS hits, count(*) FILTER (op = 'get' AND seq % 5 = 0) AS misses, sum((seq % 11 = 0)::INTEGER)::BIGINT AS expirations, sum((seq % 13 = 0)::INTEGER)::BIGINT AS evictions,
  round(count(*) FILTER (op = 'get' AND seq % 5 <> 0) / count(*) FILTER (op = 'get'), 4) AS hit_rate FROM log GROUP BY kind""",
        "cache_entries": f"WITH {_ENTRIES} SELECT key, last_accessed, created, doc_digest, kind, size FROM entries",
        "lru_evict": f"""WITH {_ENTRIES} SELECT key, size FROM entries QUALIFY sum(size) OVER (PARTITION BY store ORDER BY last_accessed DESC, key ROWS UNBOUNDED PRECEDING) <= 900""",
        "ttl_expire": f"WITH {_ENTRIES} SELECT key, last_accessed FROM entries WHERE (SELECT max(last_accessed) FROM entries) - last_accessed <= 86400.0",
        "purge_document": f"WITH {_ENTRIES} SELECT doc_digest, count(*) AS entries, sum(size)::BIGINT AS total_bytes FROM entries WHERE doc_digest NOT IN ('d3', 'd5') GROUP BY doc_digest",
        "format_sniff": """WITH f AS (SELECT page_id, [ 'pdf', 'pdf', NULL, 'ole', '?', 'mobi', 'fb2', 'epub'][page_id % 8 + 1] AS claim, ['pdf', 'fb2', NULL, 'mobi'][page_id % 4 + 1] AS found FROM pages),
g AS (SELECT *, CASE WHEN claim IN ('ole', '?') THEN 'unsupported' WHEN found IS NULL THEN CASE WHEN claim IS NULL THEN 'unsupported' ELSE 'mismatch' END WHEN claim <> found THEN 'mismatch' END AS refusal FROM f)
SELECT page_id, found, claim, refusal, CASE refusal WHEN 'unsupported' THEN 415 WHEN 'mismatch' THEN 422 ELSE 200 END AS status FROM g""",
        "ocr_words_rebuild": """WITH w AS (SELECT l_orderkey AS page_num, l_linenumber % 2 AS line_num, l_linenumber AS word_pos, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag || l_linestatus || l_partkey END AS text, CASE WHEN l_quantity < 10 THEN -1.0 ELSE l_quantity * 2 END AS conf FROM lineitem),
r AS (SELECT * FROM w WHERE trim(text) <> ''),
l AS (SELECT page_num, line_num, string_agg(text, ' ' ORDER BY word_pos, text) AS line FROM r GROUP BY ALL),
t AS (SELECT page_num, string_agg(line, chr(10) ORDER BY line_num) AS text FROM l GROUP BY ALL),
m AS (SELECT page_num, avg(conf) FILTER (conf >= 0) AS mean FROM r GROUP BY ALL),
o AS (SELECT DISTINCT w.page_num, coalesce(t.text, '') AS text, coalesce(mean, 0.0) AS mean FROM w LEFT JOIN t USING (page_num) LEFT JOIN m USING (page_num))
SELECT page_num, text, round(mean, 6) AS mean_confidence, length(text) < 40 OR mean < 60.0 AS fallback FROM o""",
        "latency_p95": """WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS median, v[floor(len(v) * 0.95)::INTEGER + 1] AS p95, v[len(v)] AS longest FROM s""",
        "multiset_recall": """WITH f AS (SELECT lang, token, count(*) AS f FROM (SELECT lang, unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY ALL),
t AS (SELECT 'en' AS lang, token, count(*) AS t FROM (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark) WHERE token <> '' GROUP BY ALL)
SELECT lang, sum(least(t, coalesce(f, 0)))::BIGINT AS hits, sum(t)::BIGINT AS truth_n, sum(least(t, coalesce(f, 0))) / sum(t) AS recall FROM t LEFT JOIN f USING (lang, token) GROUP BY lang""",
        "precision_recall": """WITH l AS (SELECT doc_id % 5 AS part, quality = 1 AS f, toxic = 0 AS t FROM labels)
SELECT part, count(*) FILTER (f AND t) AS true_positives, count(*) FILTER (f) AS found_n, count(*) FILTER (t) AS truth_n, count(*) FILTER (f AND t) / nullif(count(*) FILTER (f), 0) AS precision, count(*) FILTER (f AND t) / nullif(count(*) FILTER (t), 0) AS recall FROM l WHERE f OR t GROUP BY part""",
        "caption_coverage": f"""WITH {_CAPTIONS}, k AS (SELECT DISTINCT doc_id, page_num FROM items WHERE l_returnflag = 'R' AND NOT l_quantity < 25),
n AS (SELECT c.doc_id, number, count(k.page_num) > 0 AS hit FROM captions c LEFT JOIN k USING (doc_id, page_num) GROUP BY ALL)
SELECT doc_id, count(*) AS total, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / count(*) * 100, 6) AS pct FROM n GROUP BY doc_id""",
        "missed_captions": f"""WITH {_CAPTIONS}, k AS (SELECT DISTINCT doc_id, page_num FROM items WHERE l_returnflag = 'R' AND NOT l_quantity < 48),
h AS (SELECT DISTINCT doc_id, number FROM captions JOIN k USING (doc_id, page_num))
SELECT doc_id, number, string_agg(page_num::VARCHAR, ',' ORDER BY page_num) AS pages FROM captions c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = c.doc_id AND h.number = c.number) GROUP BY ALL""",
        "totals_by_mode": """SELECT o_orderstatus AS mode, sum(o_orderkey % 3)::BIGINT AS covered, (count(*) * 3)::BIGINT AS total, round(sum(o_orderkey % 3) / (count(*) * 3) * 100, 6) AS pct FROM orders GROUP BY ROLLUP (o_orderstatus)""",
        "detection_recall": """SELECT sum(least(o_orderkey % 7, o_custkey % 5))::BIGINT AS hits, sum(o_custkey % 5)::BIGINT AS truth_n, sum(least(o_orderkey % 7, o_custkey % 5)) / sum(o_custkey % 5) AS recall FROM orders""",
        "distinct_images": "SELECT source AS doc_id, count(DISTINCT md5(text)) AS images FROM documents WHERE text IS NOT NULL GROUP BY source",
        "merged_results": """SELECT o_orderkey AS name, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0""",
        "job_summary": """WITH j AS (SELECT user_id, (event_id % 60)::DOUBLE AS s, floor(epoch(ts)) AS b FROM events),
a AS (SELECT user_id, count(*) AS n, round(avg(s), 6) AS avg_seconds, sum(s) AS api_seconds, max(b + s) - min(b) AS elapsed FROM j GROUP BY user_id)
SELECT *, CASE WHEN elapsed >= 3600 THEN printf('%d:%02d:%02d', elapsed::BIGINT // 3600, elapsed::BIGINT % 3600 // 60, elapsed::BIGINT % 60) ELSE printf('%d:%02d', elapsed::BIGINT // 60, elapsed::BIGINT % 60) END AS took FROM a""",
        "recent_jobs": """SELECT user_id, event_id AS job_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id))::INTEGER AS rank FROM events QUALIFY rank <= 5""",
        "language_calls": f"""WITH {_blocks()}, w AS (SELECT doc_id, flatten(list({words('text')} ORDER BY page_num, seq)) AS ws FROM blocks GROUP BY doc_id),
s AS (SELECT doc_id, array_to_string(ws[1:120], ' ') AS sample FROM w),
d AS (SELECT doc_id, sample, sha256(sample)[1:32] AS digest FROM s)
SELECT doc_id, CASE WHEN sample <> '' AND doc_id IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1) AND digest[32] <> 'f' THEN 'language ' || digest ELSE '' END AS language FROM d""",
        "annotation_items": """WITH i AS (SELECT p_size::INTEGER AS page_num, 'image' AS kind, p_partkey AS k, p_name AS text, p_partkey % 2 = 0 AS placed FROM part
  UNION ALL SELECT (s_suppkey % 50 + 1)::INTEGER, 'diagram', s_suppkey, s_name, true FROM supplier)
SELECT page_num, kind, text FROM i WHERE placed AND k % 7 <> 0 AND k % 5 <> 0""",
        "page_records": """WITH r AS (
  SELECT s_suppkey::VARCHAR AS doc_id, 0 AS "index", 'f' || s_suppkey AS id, s_suppkey % 90 >= 50 AS kept, 'Text' || chr(10) || chr(10) AS head, chr(10) || chr(10) || '> cap' AS tail, s_nationkey, 842 AS height FROM supplier
  UNION ALL SELECT s_suppkey::VARCHAR, 1, 'g' || s_suppkey, s_nationkey * 9 >= 50, '', '', s_nationkey, NULL FROM supplier)
SELECT doc_id, "index", trim(head || CASE WHEN kept THEN '![' || id || '](' || id || ')' ELSE '' END || tail) AS markdown, kept::INTEGER AS n_images, CASE WHEN kept THEN round_even(s_nationkey + 0.5, 0)::INTEGER END AS top, height FROM r""",
        "html_links": r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS html FROM pages),
l AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1))))::INTEGER AS pos,
  unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS uri, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS body FROM c),
t AS (SELECT page_id, pos, uri, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS anchor FROM l)
SELECT * FROM t WHERE uri <> '' AND anchor <> ''""",
        "whitespace_words": f"SELECT doc_id, len({words('text')})::BIGINT AS words, array_to_string({words('text')}[1:3], ' ') AS head FROM documents",
        "figure_regions": f"""WITH RECURSIVE {_REGIONS}
SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(y0 / 10, 0), x0, y0, x1, y1)::INTEGER AS region_index, x0, y0, x1, y1, n AS n_drawings FROM grown""",
        "cache_replay": f"""WITH RECURSIVE {_LOG}, {_REPLAY}
SELECT store, seq, l.ts, op, k AS key, kind, outcome, expirations::INTEGER AS expirations, evictions::INTEGER AS evictions, len(held)::INTEGER AS entries, coalesce(list_sum(list_transform(held, lambda x: x.s)), 0)::BIGINT AS total_bytes
FROM run r JOIN log l USING (store, seq)""",
        "html_blocks": f"WITH {_HTML} SELECT page_id, pos, tag, text FROM texts WHERE text <> ''",
        "document_keys": f"""SELECT doc_id AS id, 'doc1-' || sha256(text) || '-' || {_fingerprint('Describe.')} AS key0, 'doc1-' || sha256(text) || '-' || {_fingerprint('Say more.')} AS key1 FROM documents WHERE text IS NOT NULL""",
        "payload_round_trip": """SELECT s_suppkey::VARCHAR AS doc_id, s_name || chr(10) || '"é"' || chr(10) AS markdown, (s_suppkey % 9)::INTEGER AS page_count, s_suppkey % 5 AS figure_count, s_suppkey % 2 AS skipped_count, 'English' AS language,
  0::BIGINT AS prompt_tokens, s_suppkey AS completion_tokens, s_suppkey * 2 AS total_tokens, s_suppkey * 3 AS api_calls, s_suppkey * 4 AS calls_missing_usage, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey / 100)::DOUBLE END AS estimated_cost, 'EUR' AS currency FROM supplier""",
        "responses": """SELECT n_nationkey AS doc_id, '{"markdown":"' || n_name || '","result":"{\\"markdown\\":\\"' || n_name || '\\",\\"page_count\\":' || n_regionkey || ',\\"figure_count\\":' || n_nationkey % 4 || '}"}' AS payload,
  n_regionkey::VARCHAR AS pages, (n_nationkey % 4)::VARCHAR AS figures FROM nation""",
        "usage_lines": """WITH k AS (SELECT n_nationkey AS k FROM nation) SELECT k AS n_nationkey, printf('%d calls, ', k * 2) || format('{:,}', k * 1000) || ' tokens (' || format('{:,}', k * 600) || ' in, ' || format('{:,}', k * 400) || ' out); '
  || CASE WHEN k % 2 = 0 THEN printf('cost about %.4f EUR', k / 8) ELSE 'cost unknown: no prices' END || CASE WHEN k % 3 > 0 THEN printf('; %d calls without usage', k % 3) ELSE '' END AS line FROM k""",
        "linkified": f"""WITH {_blocks()} SELECT doc_id, page_num, CASE WHEN len({words('text')}) >= 2 THEN regexp_replace(text, '^({_WS}*)([^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+){_WS}+([^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+)', '\\1[\\2 \\3](u' || page_num || ')') ELSE text END AS text
FROM blocks WHERE seq = 0""",
        "table_suppressors": f"""WITH {_CANDIDATES}, {_GRID},
c AS (SELECT p.page_num, p.table_id, any_value(filled / (3.0 * n_rows)) AS share, any_value(n_rows) AS n_rows, count(m.drawing_id) AS sloped FROM placed p
  LEFT JOIN marks m ON m.page_num = p.page_num AND drawing_id % 5 = 0 AND {_common('m', 'p')} >= 0.5 * (m.x1 - m.x0) * (m.y1 - m.y0) GROUP BY ALL)
SELECT page_num, table_id FROM c WHERE n_rows >= 3 AND share >= 0.45 AND sloped < 3""",
        "regions_off_tables": f"""WITH {_CANDIDATES} SELECT page_num, region_index FROM regions r WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.page_num = r.page_num AND {_common('r', 'p')} / ((r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.5)""",
        "region_blocks": f"""WITH {_CANDIDATES}, {_GRID}, l AS (SELECT page_num, max(drawing_id) AS last FROM marks GROUP BY page_num)
SELECT page_num, (coalesce(last, -1) + region_index)::INTEGER AS seq, region_index FROM regions LEFT JOIN l USING (page_num)""",
        "described_blocks": """SELECT (n_nationkey % 4 + 1)::INTEGER AS page_num, n_nationkey::INTEGER AS region_index, CASE WHEN n_nationkey % 5 <> 0 THEN
  printf('![Diagram, page %d](diagrams/page-%03d-diagram-%02d.png)', n_nationkey % 4 + 1, n_nationkey % 4 + 1, n_nationkey) || chr(10) || chr(10) || '> ' || n_name || chr(10) || '>' || chr(10) || '> and more' END AS part FROM nation""",
        "image_order": """SELECT p_size::INTEGER AS page_num, p_partkey::INTEGER AS idx, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 91 % 70 ELSE 0 END, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 37 % 50 ELSE 0 END, p_partkey)::INTEGER AS pos FROM part""",
        "box_unions": f"""WITH {_CANDIDATES} SELECT region_index, table_id, greatest(0.0, least(r.x0, p.x0))::DOUBLE AS x0, greatest(0.0, least(r.y0, p.y0))::DOUBLE AS y0, least(300.0, greatest(r.x1, p.x1))::DOUBLE AS x1, least(400.0, greatest(r.y1, p.y1))::DOUBLE AS y1
FROM regions r JOIN placed p ON p.page_num = r.page_num AND least(r.x1, p.x1) > greatest(r.x0, p.x0) AND least(r.y1, p.y1) > greatest(r.y0, p.y0)""",
        "lookup_outcomes": f"""WITH {_ENTRIES}, t AS (SELECT quantile_cont(last_accessed, 0.5) + 86400 AS now FROM entries)
SELECT key, CASE WHEN now - last_accessed > 86400.0 THEN 'expired' ELSE 'hit' END AS outcome FROM entries, t UNION ALL SELECT 'none' || n_nationkey, 'miss' FROM nation""",
        "cache_sizes": f"WITH {_ENTRIES} SELECT count(*) AS entries, sum(size)::BIGINT AS total_bytes FROM entries",
        "purged_counts": f"WITH {_ENTRIES} SELECT 'd' || n_nationkey AS doc_digest, count(size) AS entries, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM nation LEFT JOIN entries ON doc_digest = 'd' || n_nationkey GROUP BY ALL",
        "opened_entries": f"""WITH {_ENTRIES} SELECT CASE WHEN size % 11 = 0 THEN -size ELSE size END::BIGINT AS size, size % 7 <> 0 AND size % 5 <> 0 AND size % 11 <> 0 AS used FROM entries""",
        "scoped_keys": "SELECT doc_id, sha256(text)[1:8] AS shared, sha256(text)[1:8] || '-doc-' || doc_id AS own FROM documents WHERE text IS NOT NULL",
        "stored_descriptions": """WITH r AS (SELECT (o_custkey % 500)::VARCHAR AS key, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderkey::VARCHAR END AS text, o_orderstatus <> 'F' AS truncated, o_orderkey % 2 AS old FROM orders),
a AS (SELECT key, text, truncated, 1 AS age FROM r WHERE old = 0 AND trim(text) <> '' UNION ALL SELECT key, min(text), true, 0 FROM r WHERE old = 1 AND trim(text) <> '' GROUP BY key)
SELECT key, text, truncated FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY truncated, age, text) = 1""",
        "flight_outcomes": f"""WITH {_FLIGHTS} SELECT request_id, CASE WHEN leader % 5 <> 0 AND leader % 3 <> 0 THEN 'r' || leader END AS result, CASE WHEN leader % 5 = 0 THEN 'timeout' WHEN leader % 3 = 0 THEN 'broken' END AS error,
  CASE WHEN leader % 5 = 0 THEN 504 WHEN leader % 3 = 0 THEN 500 ELSE 200 END AS status FROM led""",
        "document_summaries": f"""WITH {_blocks()}, w AS (SELECT doc_id, flatten(list({words('text')} ORDER BY page_num, seq)) AS ws FROM blocks GROUP BY doc_id),
d AS (SELECT doc_id, sha256(array_to_string(ws[1:120], ' '))[1:32] AS digest, array_to_string(ws[1:120], ' ') <> '' AND doc_id IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 0) AS asked FROM w)
SELECT doc_id, CASE WHEN asked THEN 'summary ' || digest ELSE '' END AS summary, asked AND digest[32] <> 'f' AS to_keep FROM d""",
        "zip_kinds": "SELECT s_suppkey, ['epub', 'docx', 'xlsx', 'pptx', 'xps', 'cbz', NULL, NULL][s_suppkey % 8 + 1] AS kind FROM supplier",
        "size_gate": """WITH g AS (SELECT c_custkey, CASE WHEN c_custkey * 100000 > 50 * 1024 * 1024 THEN 'too_large' WHEN c_custkey % 4 = 3 THEN 'unsupported' WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 4 = 2 THEN 'unsupported' ELSE 'mismatch' END WHEN c_custkey % 4 = 1 THEN 'mismatch' END AS refusal FROM customer)
SELECT *, CASE refusal WHEN 'too_large' THEN 413 WHEN 'unsupported' THEN 415 WHEN 'mismatch' THEN 422 ELSE 200 END AS status FROM g""",
        "spreadsheet_pages": "SELECT l_suppkey AS doc_id, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING n > 50",
        "data_uris": """WITH u AS (SELECT n_nationkey, n_name, 'data:image/png;base64,' || to_base64(n_name::BLOB) AS uri FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'https://host/' || uri ELSE uri END AS uri, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS bytes FROM u""",
        "collected_images": "SELECT p_partkey AS id, md5(p_name) AS content, p_size AS width_px, NULL::INTEGER AS height_px FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0",
        "clean_grids": """SELECT n_nationkey, '[["' || n_name || ' x",""],[""]]' AS cells FROM nation""",
        "language_codes": """SELECT n_nationkey, ['Swedish', 'GERMAN', 'french', 'Klingon', '', 'Portuguese'][n_nationkey % 6 + 1] AS name, ['sv', 'de', 'fr', NULL, NULL, 'pt'][n_nationkey % 6 + 1] AS code FROM nation""",
        "numeric_tokens": """SELECT o_orderkey, printf('%.2f', o_totalprice) || ' -' || o_custkey || ' ' || strftime(o_orderdate, '%Y -%m -%d') AS numbers, true AS cell FROM orders""",
        "row_differences": """WITH l AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), r AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
d AS (SELECT o_custkey, o_orderstatus, coalesce(l.n, 0) - coalesce(r.n, 0) AS n FROM l FULL JOIN r USING (o_custkey, o_orderstatus))
SELECT o_custkey, o_orderstatus, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, abs(n) AS n FROM d WHERE n <> 0""",
    }
