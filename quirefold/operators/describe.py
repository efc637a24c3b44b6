"""Model calls on figures: prompts, keys, one call per distinct content, results joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import text as X
from quirefold.lineage import cut

#: What a model returns for one request, and whether its answer was cut off.
RESULT = "struct<text:string,truncated:boolean,prompt_tokens:bigint,completion_tokens:bigint>"
ANSWER = "struct<is_figure:boolean,kind:string,description:string>"
SKIP_CLAUSE = "If the figure is only decoration, a logo or an ornament, answer with [SKIP] alone."
AUTO = ("", "auto", "document")
#: Largest payload sent as it is, and page side beyond which a provider must shrink it.
PAYLOAD_BYTES, PAYLOAD_SIDE = 500_000, 1500


def language_clause(output: Column) -> Column:
    wanted = X.strip(F.coalesce(output, F.lit("")))
    auto = F.lit("Answer in the language of the document's text and context above; do not translate.")
    return F.when(F.lower(wanted).isin(*AUTO), auto).otherwise(F.concat(F.lit("Answer in "), wanted, F.lit(".")))


def compose_prompt(task: Column, summary: Column | None = None, before: Column | None = None, after: Column | None = None, significance: bool = False, language: Column | None = None) -> Column:
    """Document type, context and task in sections; the bare task where it stands alone.  Skip and language
    clauses belong to the task."""
    if significance:
        task = F.concat_ws("\n\n", task, F.lit(SKIP_CLAUSE))
    if language is not None:
        task = F.concat_ws("\n\n", task, language_clause(language))

    def section(title: str, body: Column | None) -> Column:
        if body is None:
            return F.lit(None).cast("string")
        return F.when(X.strip(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"[{title}]\n"), X.strip(body)))

    parts = [section("Document type", summary), section("Text context before the image", before), section("Text context after the image", after)]
    around = F.concat_ws("\n\n", *parts)
    return F.when(around == "", task).otherwise(F.concat_ws("\n\n", around, F.concat(F.lit("[Task]\n"), task)))


def cache_key(digest: Column, *settings: Column) -> Column:
    """Content and whatever shapes the answer."""
    return F.concat_ws("-", digest, X.fingerprint(*settings))


def scoped_key(key: Column, doc_digest: Column, share: bool) -> Column:
    return key if share else F.concat(key, F.lit("-doc-"), doc_digest)


def representatives(jobs: DataFrame) -> DataFrame:
    """One job per key: the first by page and number.  Only these are worth a call.

    min_by aggregates before the shuffle, so a logo on every page sends one row per task.
    """
    first = jobs.groupBy("key").agg(F.min_by(F.struct(*jobs.columns), F.struct("doc_id", "page_num", "idx")).alias("first"))
    return first.select("first.*")


def with_known(jobs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with text, misses) of jobs against a table (key, text)."""
    known = cache.select("key", "text").dropDuplicates(["key"])
    return jobs.join(known, "key"), jobs.join(known.select("key"), "key", "left_anti")


def call_model(jobs: DataFrame, model: Callable[[str, str, str], dict], attempts: int = 3, workers: int | None = None) -> DataFrame:
    """jobs (key, kind, digest, prompt) with result, by model(kind, digest, prompt) in Arrow batches.

    The answers are not deterministic in general: write them before they are used twice.  Raster
    images are tried again on failure; an empty answer and the last failure stop the job.  workers bounds
    the number of calls in flight.
    """

    @F.pandas_udf(RESULT)
    def answer(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, digests, prompts in batches:
            yield pd.DataFrame([_attempted(model, attempts if k == "image" else 1, k, d, p) for k, d, p in zip(kinds, digests, prompts)], columns=["text", "truncated", "prompt_tokens", "completion_tokens"])

    rows = jobs if workers is None else jobs.repartition(workers)
    return rows.withColumn("result", answer.asNondeterministic()("kind", "digest", "prompt"))


class StructuredFirst:
    """A model for call_model that asks an endpoint for a structured answer to a raster image first.

    structured(kind, digest, prompt) may raise Unsupported; then, and for all else that is no image, plain() is asked.
    Each worker remembers of each endpoint that it cannot, so the question is put once, not for every image.
    """

    _plain_only: set[str] = set()

    def __init__(self, endpoint: str, structured: Callable[[str, str, str], dict], plain: Callable[[str, str, str], dict]):
        self.endpoint, self.structured, self.plain = endpoint, structured, plain

    def __call__(self, kind: str, digest: str, prompt: str) -> dict:
        if kind == "image" and self.endpoint not in self._plain_only:
            try:
                return self.structured(kind, digest, prompt)
            except Unsupported:
                self._plain_only.add(self.endpoint)
        return self.plain(kind, digest, prompt)


class Unsupported(Exception):
    """An endpoint does not give structured answers."""


def _attempted(model: Callable[[str, str, str], dict], attempts: int, kind: str, digest: str, prompt: str) -> tuple:
    import time

    for k in range(attempts):
        try:
            got = model(kind, digest, prompt)
            break
        except ConnectionError:
            if k + 1 == attempts:
                raise
            time.sleep(2**k)
    if not (got.get("text") or "").strip():
        raise ValueError(f"empty answer for {kind} {digest}")
    return got["text"], bool(got.get("truncated")), got.get("prompt_tokens"), got.get("completion_tokens")


def fake_model(kind: str, digest: str, prompt: str) -> dict:
    """A pure function of its arguments, for tests: answers do not depend on partitioning."""
    skip = "[SKIP]" in prompt and digest.endswith("0")
    return {"text": "[SKIP]" if skip else f"{kind} {digest}", "truncated": digest.endswith("f"), "prompt_tokens": 10, "completion_tokens": 5}


def parsed_answer(text: Column) -> Column:
    """A structured answer as [SKIP] or its description; anything else as it is."""
    got = F.from_json(text, ANSWER)
    structured = got["is_figure"].isNotNull() & got["description"].isNotNull()
    return F.when(structured, F.when(got["is_figure"], got["description"]).otherwise(F.lit("[SKIP]"))).otherwise(text)


def describe(jobs: DataFrame, cache: DataFrame, model: Callable[[str, str, str], dict], workers: int | None = None) -> DataFrame:
    """jobs with text and cached: known texts first, then one call for each distinct key that is left.

    The calls are deduplicated and materialised before the join back, so no plan repeats them.
    """
    hits, misses = with_known(jobs, cache)
    called = cut(call_model(representatives(misses), model, workers=workers).select("key", "result"))
    fresh = misses.join(called.select("key", F.col("result.text").alias("text"), F.col("result.truncated").alias("truncated")), "key")
    return hits.select(*jobs.columns, "text", F.lit(False).alias("truncated"), F.lit(True).alias("cached")).unionByName(fresh.select(*jobs.columns, "text", "truncated", F.lit(False).alias("cached")))


def to_share(results: DataFrame) -> DataFrame:
    """(key, text) that may enter the shared cache: whole, not blank, once.

    The rest is kept beside it by stored(), so that a cut-off answer can be told from none.
    """
    return results.where(~F.col("truncated") & (X.strip(F.col("text")) != "")).select("key", "text").dropDuplicates(["key"])


def stored(results: DataFrame, known: DataFrame) -> DataFrame:
    """known descriptions (key, text, truncated) with those of results that are new, blank ones left out; a whole
    answer replaces a truncated one, never the other way."""
    new = results.where(X.strip(F.coalesce("text", F.lit(""))) != "").select("key", "text", "truncated")
    rows = known.select("key", "text", "truncated", F.lit(0).alias("_age")).unionByName(new.withColumn("_age", F.lit(1)))
    best = rows.groupBy("key").agg(F.min_by(F.struct("text", "truncated"), F.struct("truncated", "_age", "text")).alias("b"))
    return best.select("key", "b.text", "b.truncated")


def needs_shrinking(files: DataFrame) -> DataFrame:
    return files.where(F.length("content") > PAYLOAD_BYTES)


#: JPEG qualities that are tried one after the other, and the longest side of what is sent.
QUALITIES = (85, 70, 55, 40)


def fitted(files: DataFrame, encode: Callable[[bytes, int, int], bytes], strict: bool = False) -> DataFrame:
    """files with content of PAYLOAD_BYTES at most: small ones as they are, others by encode(content, side, quality)
    at falling qualities until one fits.  What never fits goes out at the last quality, or, strict, stops the job.

    encode comes with an image library of the cluster's; only large files reach Python.
    """

    def shrunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield contents.map(lambda c: None if c is None else _fitted(bytes(c), encode, strict))

    large = F.length("content") > PAYLOAD_BYTES
    small = files.where(~F.coalesce(large, F.lit(False)))
    return small.unionByName(files.where(large).withColumn("content", F.pandas_udf(shrunk, "binary")("content")))


def _fitted(content: bytes, encode: Callable[[bytes, int, int], bytes], strict: bool) -> bytes:
    for quality in QUALITIES:
        out = encode(content, PAYLOAD_SIDE, quality)
        if len(out) <= PAYLOAD_BYTES:
            return out
    if strict:
        raise ValueError(f"{len(out)} bytes after the last quality, {PAYLOAD_BYTES} are sent at most")
    return out


LANGUAGE_PROMPT = "Name the language of this text in one English word."
SUMMARY_PROMPT = "Say in one or two sentences what kind of document this is and what it is about."


def ask_documents(samples: DataFrame, figures: DataFrame, prompt: str, kind: str, model: Callable[[str, str, str], dict]) -> DataFrame:
    """(doc_id, text, truncated): one answer for each document that has figures and a sample; documents
    without figures cost no call."""
    asked = samples.where("sample <> ''").join(figures.select("doc_id"), "doc_id", "left_semi")
    jobs = asked.select("doc_id", F.lit(kind).alias("kind"), F.substring(F.sha2("sample", 256), 1, 32).alias("digest"), F.concat(F.lit(f"{prompt}\n\n"), "sample").alias("prompt"))
    return call_model(jobs, model, attempts=1).select("doc_id", "result.text", "result.truncated")


def languages(samples: DataFrame, figures: DataFrame, model: Callable[[str, str, str], dict]) -> DataFrame:
    """(doc_id, language): the model's word for the language, empty for none or for an answer that was cut off."""
    said = ask_documents(samples, figures, LANGUAGE_PROMPT, "language", model)
    name = F.when(F.col("truncated"), F.lit("")).otherwise(X.language_name(F.col("text")))
    return samples.select("doc_id").join(said, "doc_id", "left").select("doc_id", F.coalesce(name, F.lit("")).alias("language"))


def summaries(samples: DataFrame, figures: DataFrame, model: Callable[[str, str, str], dict]) -> DataFrame:
    """(doc_id, summary, to_keep): a cut-off summary is used but not kept for later."""
    said = ask_documents(samples, figures, SUMMARY_PROMPT, "summary", model)
    joined = samples.select("doc_id").join(said, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("text", F.lit("")).alias("summary"), F.coalesce(~F.col("truncated"), F.lit(False)).alias("to_keep"))
