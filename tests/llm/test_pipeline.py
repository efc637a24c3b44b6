import math
import re

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F
from quirefold.llm import quality, queries
from quirefold.llm import secrets as S
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"
CLASHES = "_row _rid _id _own _blob _found rid id grade kept node blob found taken".split()


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mix"]
    assert corpus_pipeline.ORACLE_SQL is None


def holds(text, items):
    """Whether the text holds an item within its tenth of edits, by the plain recurrence over all items at once."""
    longest = max(map(len, items))
    codes = np.array([[ord(c) for c in x.ljust(longest, "\0")] for x in items])
    at, sizes = np.arange(longest + 1), np.array([len(x) for x in items])
    budgets, rows = np.array([int(len(x) * 0.1) for x in items]), np.arange(len(items))
    column = np.tile(at, (len(items), 1))
    for c in text:
        new = np.concatenate([np.zeros((len(items), 1), dtype=int), np.minimum(column[:, 1:] + 1, column[:, :-1] + (codes != ord(c)))], axis=1)
        column = np.minimum.accumulate(new - at, axis=1) + at
        if (column[rows, sizes] <= budgets).any():
            return True
    return False


def test_run_equals_brute_force(spark):
    """Each stage again by other means; only the fitted weights and the features of a text are the operator's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text):
        score = sum(float(model.weights[b]) * float(v) for b, v in zip(*quality.features(text)))
        return 1 / (1 + math.exp(model.thresholds[-1] - score)) >= 0.7

    rows = [r for r in docs.collect() if good(r.text)]
    keep = {d for d, _, _, kept in brute([(r.doc_id, r.text) for r in rows]) if kept}
    plain = lambda text: " ".join(text.lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if r.doc_id in keep and not holds(plain(r.text), items)]

    def masked(text):
        spans = sorted({(a, rank, b, rule.name) for rank, rule in enumerate(S.RULES) for a, b in ((m.start(), m.end()) for m in re.finditer(rule.pattern, text, re.A | (re.I if rule.any_case else 0)) if len(m[rule.group] or "") >= rule.least)})
        out, at = "", 0
        for a, _, b, name in spans:
            if b > at:
                out += (text[at:a] + f"[{name}]") if a >= at else ""
                at = b
        return out + text[at:]

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, masked(r.text), r.source) for r in rows])
    want = sorted(con.execute(f"SELECT doc_id, source, shard, size, source_size, target, taken FROM ({queries.oracle_sql()['op7_sainte_lague_mix']}) WHERE taken > 0").fetchall())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "shard", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns({c: F.lit(1.0) for c in CLASHES})
    odd = [(None, None, None, None, None), (1_000_000, "", "en", None, 0), (1_000_001, "x" * 100_000, None, "s", 100_000), (0, "again an id", "en", "src0", 11)]
    odd = spark.createDataFrame([(*r, *[2.0] * len(CLASHES)) for r in odd], docs.schema)
    for rows in (docs.unionByName(odd).unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            if name != "mix":
                assert rows.columns == docs.columns, name
        rows.collect()
