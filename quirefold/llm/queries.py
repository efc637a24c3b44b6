"""The registered queries of this subpackage: thin digests of its operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chat, decontam, embdedup, langid, mixing, neardup, pii, quality, secrets, urlfilter
from quirefold.llm.common import table


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_hmm_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learnt from the conversations whose crc32(conv_id) mod 4 is not 2 and recovered for all."""
    turns = table(spark, sf_dir, "conversations")
    model = chat.learn(turns.where(F.crc32(F.col("conv_id").cast("string")) % 4 != 2))
    return chat.parse(turns, model)


def op4_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: the ledger of one half of the documents, then all of them against it, so that the second scan reads
    only what the first has not seen.  The result is that of one scan of the whole table."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0))
    found, _ = secrets.scan(docs, ledger=ledger)
    return secrets.digest(found)


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.is_held_out() & F.col("doc_id").isNotNull()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", langid.told("spans").alias("spans"))


def op9_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_hyperplane_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_disclosure, op2_hyperminhash_neardup, op3_hmm_chat_turns, op4_pigeonhole_decontam, op5_ordinal_quality, op6_secret_blob_ledger, op7_sainte_lague_mix, op8_viterbi_langid, op9_url_ngram_filter, op10_hyperplane_neardup)}


#: The mix from its definitions: every quotient and every block is listed.
_MIX = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight FROM src),
sums AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights,
    coalesce(sum(source_size) OVER b, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
  FROM weighed WINDOW b AS (ORDER BY source_size * 6.0 / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, weight * (words::DOUBLE * 1.5 - size_before * 2) >= 2.0::DOUBLE * source_size * (weights - weight_before) AS full_up FROM sums),
targets AS (
  SELECT source, source_size, place, CASE WHEN full_up THEN source_size * 2.0::DOUBLE ELSE weight * ((words::DOUBLE * 1.5
    - coalesce(sum(source_size) FILTER (full_up) OVER (), 0)::BIGINT * 2) / (weights - coalesce(sum(weight) FILTER (full_up) OVER (), 0)::BIGINT)) END::DOUBLE AS target
  FROM capped),
sizes AS (SELECT sum(source_size)::BIGINT AS words, coalesce(min(source_size) FILTER (source_size > 0), 0)::BIGINT AS least, sum(floor(target + 0.5))::BIGINT AS votes FROM targets),
params AS (SELECT greatest(1, least(256, least // 64))::BIGINT AS block, greatest(65536, 16 * floor(sqrt(words))) AS per_shard, votes FROM sizes),
seats AS (SELECT *, floor(votes / block + 0.5)::BIGINT AS seats FROM params),
quotients AS (SELECT place, floor(target + 0.5) / (2 * k + 1) AS q, k, seats FROM targets, seats, LATERAL (SELECT unnest(range(seats + 1)) AS k) WHERE floor(target + 0.5) > 0),
won AS (SELECT * FROM quotients QUALIFY row_number() OVER (ORDER BY q DESC, place, k) <= seats),
quota AS (SELECT place, count(*) AS source_quota FROM won GROUP BY place),
keyed AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM sized),
dealt AS (
  SELECT d.*, ('0x' || key[1:12])::BIGINT % greatest(1, ceil(source_size / per_shard))::BIGINT AS shard
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, params),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt),
held AS (SELECT place, d.source, shard, sum(size)::BIGINT AS held FROM dealt d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
shard_quotients AS (SELECT place, shard, held / (2 * k + 1) AS q, k, source_quota FROM held JOIN quota USING (place), LATERAL (SELECT unnest(range(source_quota + 1)) AS k) WHERE held > 0),
shard_won AS (SELECT * FROM shard_quotients QUALIFY row_number() OVER (PARTITION BY place ORDER BY q DESC, shard, k) <= source_quota),
shard_quota AS (SELECT place, shard, count(*) AS quota FROM shard_won GROUP BY ALL),
blocks AS (
  SELECT h.place, h.source, h.shard, ceil(held / block)::BIGINT AS m, least(coalesce(quota, 0), 2 * ceil(held / block)::BIGINT) AS quota, block
  FROM held h LEFT JOIN shard_quota USING (place, shard), params WHERE held > 0),
started AS (SELECT *, ('0x' || md5('17:' || place || ':' || shard)[1:12])::BIGINT % m AS start FROM blocks),
each_block AS (
  SELECT source, shard, i * block AS low, (i + 1) * block AS high, quota // m + ((i + 1 + start) * (quota % m) // m - (i + start) * (quota % m) // m) AS times
  FROM started, LATERAL (SELECT unnest(range(m)) AS i)),
took AS (
  SELECT p.doc_id, p.key, p.source, p.shard, p.size, p.stop, coalesce(sum(times * greatest(0, least(high, p.stop) - greatest(low, p.stop - p.size))), 0)::BIGINT AS taken
  FROM placed p LEFT JOIN each_block b ON b.source IS NOT DISTINCT FROM p.source AND b.shard = p.shard AND low < p.stop AND high > p.stop - p.size GROUP BY ALL)
SELECT doc_id, k.source, shard, size, source_size, target, taken FROM took k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
"""



#: Base spans from where the matches stand between the pieces that the text splits into.  The tables given hold no
#: credentials of the further rules, so these are all spans.
_SECRETS = r"""
WITH patterns AS (
  SELECT * FROM (VALUES (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)) v(rank, kind, pattern, part, least)),
cut AS (
  SELECT doc_id, rank, kind, least, regexp_split_to_array(coalesce(text, ''), pattern) AS between, regexp_extract_all(coalesce(text, ''), pattern, 0) AS whole,
    CASE WHEN part = 2 THEN regexp_extract_all(coalesce(text, ''), pattern, 2) ELSE regexp_extract_all(coalesce(text, ''), pattern, 0) END AS part
  FROM documents, patterns),
each_match AS (SELECT doc_id, rank, kind, least, between, whole, unnest(range(1, len(whole) + 1)) AS i, unnest(part) AS part FROM cut),
placed AS (
  SELECT doc_id, rank, kind, least, length(part) AS size, length(whole[i]) AS span,
    list_sum(list_transform(between[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM each_match),
kept AS (SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || (start + span) AS told FROM placed WHERE size >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(told, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""

#: Shingles as texts, all pairs that share one, and reachability by recursion.
_NEAR = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN lowest USING (doc_id)
"""

#: All pairs of a label by cosine in double precision, and reachability by recursion.
_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
lowest AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN lowest USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hyperminhash_neardup": _NEAR, "op6_secret_blob_ledger": _SECRETS, "op7_sainte_lague_mix": _MIX, "op10_hyperplane_neardup": _VECTORS}
