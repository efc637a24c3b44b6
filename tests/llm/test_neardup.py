import random
import re

import numpy as np
import pytest

from quirefold.llm import neardup
from quirefold.llm import shingles as S


def brute(rows):
    """(id, n, component, kept) by comparing all pairs."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), low, doc is not None and doc == low))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, base), (3, base), (9, base.upper()), (4, base.replace("w30", "x")), (7, None), (8, ""), (10, " \t\n"),
        (11, "one two"), (12, "ONE  two"), (13, "one two three"), (14, "a b c d e f"), (15, "word " * 50_000),
        (16, "word word word word word"), (3, "other text of the same id"), (None, base), (None, "no id here at all friend"),
        (3, base), (20, "É é"), (21, "é é"), (22, "x" * 200_000),
    ]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, kept string, n_shingles int")
    assert rows_of(neardup.near_duplicates(df)) == brute(rows)


def test_deduplicate_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base, "b"), (3, base.upper(), "c"), (3, base.upper(), "c"), (4, base.replace("w30", "x"), "d"), (7, None, "e"), (8, "", "f"), (None, "only null ids", "g"), (None, "only null ids", "h"), (3, "other text", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(3, base.upper()), (7, None), (8, ""), (None, "only null ids"), (3, "other text")], key=str)


def test_empty_table(spark):
    df = neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert df.collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies_match_brute_force(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    passage = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(40):
        base = [word() for _ in range(rnd.choice([6, 9, 20, 60, 150, 400]))]
        if rnd.random() < 0.5:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    rnd.shuffle(rows)
    monkeypatch.setattr(neardup, "BLOCK", 4)  # deal buckets out as blocks
    monkeypatch.setattr(neardup, "SETS", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(neardup.near_duplicates(df)) == brute(rows)


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert rows_of(neardup.near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("n", [30, 255, 256, 3000])
def test_sets_of_every_size_use_all_bands(n):
    """A pair that agrees in the last band only still meets, however large its sets."""
    rng = np.random.default_rng(n)
    a, b = (S.registers(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))) for _ in range(2))
    a[a == 0], b[b == 0] = 7, 9
    b[-S.BAND_ROWS :] = a[-S.BAND_ROWS :]
    source = neardup.pa.RecordBatch.from_arrays([neardup.pa.array([1, 2]), neardup.pa.array([a.tobytes(), b.tobytes()], neardup.pa.binary()), neardup.pa.array([n, n])], names=["node", "sig", "n"])
    keys = {}
    for batch in neardup._bands([source]):
        for key, node in zip(*(c.to_pylist() for c in batch.columns)):
            keys.setdefault(node, set()).add(key)
    assert len(keys[1]) == len(keys[2]) == S.BANDS and keys[1] & keys[2]


def test_registers_keep_zeros_and_mantissa():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    got = S.registers(hashes)
    rest = 64 - S.BUCKET_BITS
    for bucket in range(S.BUCKETS):
        mine = [int(h) & ((1 << rest) - 1) for h in hashes if int(h) >> rest == bucket]
        low = f"{min(mine):0{rest}b}"
        zeros = len(low) - len(low.lstrip("0"))
        mantissa = (low[zeros + 1 :] + "1" + "0" * 20)[: S.MANTISSA]
        assert got[bucket] == ((zeros + 1) << S.MANTISSA) | int(mantissa, 2)


@pytest.mark.parametrize("n, j", [(2000, 0.75), (400, 0.5), (30, 0.8)])
def test_estimate_is_close(n, j):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 1 << 64, int(n * 2 * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, n - len(both), dtype=np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(S.estimate(S.registers(a), S.registers(b), len(a), len(b)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("union", [4, 8, 20, 60, 100, 180, 300, 700, 2000])
def test_no_pair_at_the_threshold_is_lost(union):
    """Pairs of sets exactly at 0.75: every estimate sends them on, and they meet in a band."""
    rng = np.random.default_rng(union)
    common, left = union * 3 // 4, union // 8
    regs, sizes = [], []
    for _ in range(400):
        all_of = rng.integers(0, 1 << 64, union, dtype=np.uint64)
        both, rest = all_of[:common], all_of[common:]
        for part in (rest[:left], rest[left:]):
            hashes = np.unique(np.concatenate([both, part]))
            regs.append(S.registers(hashes))
            sizes.append(len(hashes))
    regs, n = np.stack(regs), np.array(sizes)
    assert neardup._likely(regs[::2], regs[1::2], n[::2], n[1::2]).all()
    keys = S.band_keys(regs)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


@pytest.mark.parametrize("extra", "_row _rid _id _ROW row rid id node n sig body key".split())
def test_deduplicate_carries_any_column(spark, extra):
    df = spark.createDataFrame([(1, "one two three", 7.5), (2, "ONE two three", 1.0), (3, None, None), (3, None, None)], f"doc_id long, text string, `{extra}` double")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "one two three", 7.5), (3, None, None)]


def test_intermediate_tables_are_deleted(spark):
    from quirefold.llm import common

    before = common.written()
    df = neardup.near_duplicates(spark.createDataFrame([(i, f"text number {i % 3} of some few words here") for i in range(30)], "doc_id long, text string"))
    assert len(common.written() - before) == 2 and df.count() == 30


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from quirefold.llm import common

    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert common.scratch_dir(session).startswith("file:")
        else:
            with pytest.raises(ValueError):
                common.scratch_dir(session)
