"""Incremental secret scans over a content-addressed ledger of blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import batches, every, in_arrow, materialise, quoted, unused


@dataclass(frozen=True)
class Rule:
    """A pattern, the least length of its group, and the literals one of which a lower-cased text
    must hold for the pattern to match at all (none: always tried)."""

    name: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    literals: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """Changes whenever what the rule finds may change."""
        told = repr((self.name, self.pattern, self.least, self.group, self.any_case))
        return f"{self.name}@{hashlib.sha256(told.encode()).hexdigest()[:12]}"

    def finder(self) -> Callable[[str, str], Iterator[tuple[int, int]]]:
        # ASCII: otherwise the Kelvin sign and the long s count as letters in either case.
        regex = re.compile(self.pattern, (re.IGNORECASE if self.any_case else 0) | re.ASCII)

        def find(text: str, lowered: str) -> Iterator[tuple[int, int]]:
            if self.literals and not any(x in lowered for x in self.literals):
                return
            for m in regex.finditer(text):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.start(), m.end()

        return find


#: The three rules that every result rests on.  The last pattern asks for 32 digits at once, which finds
#: the same runs as `[0-9a-f]+` of 32 or more.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, False, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
# Of a private key: white space, also as escapes; its base64 lines where no END line follows, the last one shorter.
_SPACE = r"(?:\s|\\[nr])"
_BODY = rf"""(?:{_SPACE}*+(?:Proc-Type:\x20*4,ENCRYPTED|DEK-Info:\x20*[A-Z0-9-]++,\x20*[0-9A-Fa-f]++))*+(?:{_SPACE}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_SPACE}++[A-Za-z0-9+/]{{0,15}}={{1,2}}|(?:\n|\\n)\x20*[A-Za-z0-9+/]{{1,15}}(?=\x20*(?:\s*\Z|\r?\n|\\[nr]|["'])))?"""
#: Further credentials with fixed shapes.  A pem key runs to its END line; up to the next BEGIN or END line no text is
#: read twice.  The jwt pattern also takes first parts that nothing follows, so that no run is read from each of its
#: hyphens; these lack the group and are dropped.
RULES = (
    *BASE,
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_BODY})?", 1, 0, False, ("private key-----",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,255}", 40, 0, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,250}", 15, 0, False, ("xox",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}+(\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?", 21, 1, False, ("eyj",)),
)
FOUND = "array<struct<start:int,rank:int,rule:string,stop:int>>"
#: Spans of the ledger also name the rule version that found them.
_HELD = "array<struct<start:int,rank:int,rule:string,stop:int,version:string>>"
_HELD_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("rule", pa.string()), ("stop", pa.int32()), ("version", pa.string())]))
LEDGER = f"blob binary, versions array<string>, found {_HELD}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _scanned(source: Iterable[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    """(blob, versions, text) rows become ledger rows; only the rules named in versions run."""
    finders = {r.version: (rank, r.name, r.finder()) for rank, r in enumerate(rules)}

    def rows() -> Iterator[tuple]:
        for batch in source:
            for blob, versions, text in zip(*(c.to_pylist() for c in batch.columns)):
                lowered = text.lower()
                found = [
                    {"start": start, "rank": rank, "rule": name, "stop": stop, "version": version}
                    for version in versions
                    for rank, name, find in (finders[version],)
                    for start, stop in find(text, lowered)
                ]
                found.sort(key=lambda f: (f["start"], f["rank"]))
                yield blob, versions, found

    yield from batches({"blob": pa.binary(), "versions": pa.list_(pa.string()), "found": _HELD_TYPE}, rows())


def scan(history: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger) of a history with one row per path and version.

    Every text is addressed by its sha256 (null counts as empty).  The ledger has rows (blob, versions, found): which
    rule versions a blob was scanned with, and the spans found, in code points, each with its rule version.  A blob is scanned once, with the
    current rule versions that the ledger lacks for it; copies, renames and reverts cost nothing.
    findings has one row per row of history: path_col, blob, found, the spans of the current rule
    versions in order of start and rule, as a scan without a ledger gives them.  The new ledger holds the old rows and one row for each blob scanned
    now, to be appended to where it is kept.  One row per blob represents its text, so that a text
    crosses the cluster once, whatever the number of its copies.

    Other columns of history are ignored.  Rows of an empty table give no findings and no entries.
    """
    spark = history.sparkSession
    rows = history.select(quoted(path_col).alias("path"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    keyed = rows.select("path", blob_of(F.col("text")).alias("blob"), F.xxhash64(F.col("path").cast("string"), "text").alias("rid"))
    keyed = materialise(keyed, "paths")
    blobs = keyed.groupBy("blob").agg(F.min("rid").alias("rid"))
    current = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        due = blobs.withColumn("versions", current)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
        due = blobs.join(seen, "blob", "left").withColumn("versions", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))).where("size(versions) > 0").drop("seen")
    due = due.select("blob", "versions", "rid")
    texts = rows.select("text", F.xxhash64(F.col("path").cast("string"), "text").alias("rid"))
    # rid only brings a text to its blob; the address decides, so a chance collision does no harm.
    fetched = texts.join(due.hint("shuffle_hash"), "rid").where(blob_of(F.col("text")) == F.col("blob"))
    # Repeated rows bring a blob twice; they go before the write, so that the joins below read plain tables.
    once = materialise(fetched.select("blob", "versions", "text").transform(in_arrow, partial(_scanned, rules=rules), LEDGER).dropDuplicates(["blob"]), "ledger")
    full = once if ledger is None else ledger.select("blob", "versions", "found").unionByName(once)
    hits = full.where(F.size("found") > 0)
    if ledger is not None:
        listed = hits.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
        # Ranks are those of the current rules, whatever their order was when a span was found.
        listed = listed.withColumn("found", F.filter("found", lambda f: f["version"].isin([r.version for r in rules])))
        listed = listed.withColumn("found", F.transform("found", lambda f: f.withField("rank", (F.array_position(current, f["version"]) - 1).cast("int"))))
        hits = listed.withColumn("found", F.array_sort(F.array_distinct("found")))
    found = keyed.select("path", "blob").join(hits.select("blob", "found"), "blob", "left")
    empty = F.array().cast(FOUND)
    own = F.transform("found", lambda f: f.dropFields("version"))
    return found.select(F.col("path").alias(path_col), "blob", F.coalesce(own, empty).alias("found")), full


def _masked(source: Iterable[pa.RecordBatch], text_at: int, count_at: int | None) -> Iterator[pa.RecordBatch]:
    for batch in source:
        texts = []
        for text, found in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            parts, at = [], 0
            for f in found:
                if f["stop"] <= at:
                    continue
                if f["start"] >= at:
                    parts += [text[at : f["start"]], f"[{f['rule']}]"]
                at = f["stop"]
            texts.append("".join([*parts, text[at:]]))
        columns = batch.columns[:-1]
        columns[text_at] = pa.array(texts, batch.schema.types[text_at])
        if count_at is not None:
            columns[count_at] = pa.array(map(len, texts), pa.int64()).cast(batch.schema.types[count_at])
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def redact(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every finding replaced by its rule's name in brackets; overlapping spans become one mark.

    count_col, where given, gets the new length.  Rows without findings, nulls among them, pass
    as they are.  Findings are joined by blob, so all copies and repeated rows are treated alike.  Very long texts are
    scanned whole, an empty table stays empty, and all columns are carried, whatever their names.
    """
    _, ledger = scan(docs, path_col, text_col, None, rules)
    own, blob, found = unused(docs, "_own", "_blob", "_found")
    hits = materialise(ledger.where(F.size("found") > 0).select(F.col("blob").alias(blob), F.col("found").alias(found)), "hits")
    keyed = docs.select(*every(docs), blob_of(quoted(text_col)).alias(own))
    joined = keyed.join(hits, F.col(own) == F.col(blob), "left").select(*every(docs), F.col(found))
    clean = joined.where(F.col(found).isNull()).select(*every(docs))
    names = docs.columns
    count_at = names.index(count_col) if count_col else None
    dirty = joined.where(F.col(found).isNotNull()).transform(in_arrow, partial(_masked, text_at=names.index(text_col), count_at=count_at), docs.schema)
    return clean.unionByName(dirty)


def digest(findings: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """n_<rule> counts of the base rules, base_sha256 and spans, in place of blob and found."""
    told = lambda found: F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["stop"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("found", lambda f: f["rule"] == name)).cast("long")
    counts = [count(r.name).alias(f"n_{r.name}") for r in base]
    own = F.filter("found", lambda f: f["rule"].isin([r.name for r in base]))
    keep = [c for c in findings.columns if c not in ("blob", "found")]
    return findings.select(*keep, *counts, F.sha2(told(own), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


