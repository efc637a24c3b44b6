import hashlib
import random
import re

import pytest

from quirefold.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    """Base spans straight from the stated patterns."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(spans)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


CASES = [
    None, "", "plain", "a@b.c", "x..%+-@d-e.f.gg. @q.w a@b a@b..c a@b.c.d@e.f", "a@b.c+d@e.f@g.h", "é mail: Jo.Doe+x@mail-1.example.org, 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 0300.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4746305060325671 1 2 3 4 5 6 7 8 9 0 1 2 3 79927398713 799273987130", "+1 (865) 555-4577 +44.20.7946.0958 +1 +12345678 +1(((((2 +123456789012345 +1234567890123456",
    "9" * 5000 + " " + "1." * 3000, "a" * 30_000 + "@" + "b" * 30_000, "1 " * 20_000, "😀 ip 10.0.0.1😀", "+1" * 9000, "@" * 9000, "a@a." * 3000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_of_cases(text):
    assert pii.base_spans(text or "") == brute(text)


def test_base_spans_of_random_texts():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1.2@-+ ()9%0é\n") for _ in range(rnd.choice([5, 30, 80])))
        assert pii.base_spans(text) == brute(text), text


def test_very_long_text_takes_linear_time():
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1.1." * 250_000, "+1 " * 300_000):
        pii.base_spans(text)


def test_digest_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(want)
    for r in got:
        spans = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in spans) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest()
        assert set(told(spans).split(",")) <= set(r.spans.split(",")) | {""}


def corpus():
    """Zorblax is only seen near one address, quillon nearly so; everything else is common."""
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "ypsilon"]) + rnd.choice(["", "tic", "ness", "ing"])
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(400):
        text = fill(40)
        if i % 20 == 0:
            text = f"{fill(10)} {fill(1)}x{'abcdefghijklmnopqrst'[i // 20]}unique Zorblax quillon jo@mail.example.com {fill(12)}"
        elif i % 20 == 7:
            text = f"{fill(9)} person{i}@mail.example.com {fill(9)}"
        elif i % 100 == 3:
            text += " quillon"
        rows.append((i, text))
    return rows


def test_terms_that_reveal_an_entity_are_marked(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    marked = {(rows[d][1][s["start"] : s["stop"]], s["kind"]) for d, spans in got.items() for s in spans if s["rank"] >= 4}
    assert marked == {("Zorblax", pii.REVEAL), ("quillon", pii.QUASI)}
    assert sum(s["kind"] == pii.QUASI for s in got[3]) == 1  # wherever the term stands
    for d, text in rows:
        assert [tuple(s) for s in got[d] if s["rank"] < 4] == brute(text)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zorblax" not in clean[0] and "quillon" not in clean[0] and "<email>" in clean[0] and "<word:long>" in clean[3]
    assert clean[1] == rows[1][1]


def test_shares_equal_brute_force(spark):
    import math
    from functools import partial

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id id", "doc_id rid", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    columns = {"id": to_arrow_type(df.schema["id"].dataType), "rid": pii.pa.int64(), "base": pii._SPAN_TYPE, "entities": pii.pa.list_(pii.pa.string()), "near": pii._NEAR_TYPE, "context": pii.pa.int64()}
    scanned = df.mapInArrow(partial(pii._scanned, columns=columns), f"id long, rid long, base {pii._SPANS}, entities array<string>, near {pii._NEAR}, context long")
    got = {r.term: r.share for r in pii.disclosures(scanned, df, generalise=-9.0, remove=2.0).collect()}
    near, has, term = {}, {}, {}
    for d, text in rows:
        for t in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", text)}:
            term.setdefault(t, set()).add(d)
        spans = pii.base_spans(text)
        entities, pairs = pii._nearby(text, spans)
        for x in entities:
            has.setdefault(x, set()).add(d)
        for x, t in pairs:
            near.setdefault((x, t), []).append((d, text))
    want = {}
    for (e, t), seen in near.items():
        if len({c for _, c in seen}) >= pii.SUPPORT:
            info = -math.log2(len(has[e]) / len(rows))
            want[t] = max(want.get(t, -99), (info + math.log2(len({d for d, _ in seen}) / len(term[t]))) / info)
    assert got == pytest.approx(want)


def test_copies_are_one_context(spark):
    df = spark.createDataFrame([(i, "the rare zygote wrote to jo@mail.example.com about things") for i in range(50)] + [(100, None), (None, "")], "doc_id long, text string")
    got = pii.find(df).collect()
    assert len(got) == 52 and all(s["rank"] < 4 for r in got for s in r.spans)


def test_the_eight_terms_next_to_an_entity_are_seen():
    near = lambda text: {t for _, t in pii._nearby(text, pii.base_spans(text))[1]}
    far = " ".join(f"word{c}" for c in "abcdefgh")
    assert near(f"outside {far} {'=' * 500} a@b.example {'/' * 500} {far} beyond") == set(far.split())
    assert near("record MRN48213 774411 a@b.example \u738b\u4f1f, an \u0438\u0437 xy") == {"record", "mrn48213", "774411", "\u738b\u4f1f", "\u0438\u0437"}
    assert near("one a@b.example two c@d.example " + far) == {"one", "two", *far.split()}
    pii_text = "a@b.example zz " * 30_000 + "end"  # in time linear in the text
    assert near(pii_text) == {"end"}


def test_a_signature_in_different_documents_discloses(spark):
    """One signature has the same neighbours everywhere; the documents around it differ."""
    rnd = random.Random(6)
    fill = lambda n: " ".join(f"{rnd.choice('abcdefgh')}word{rnd.choice('klmnop')}{rnd.choice('qrstuv')}" for _ in range(n))
    rows = [(i, f"{fill(40)} best regards Anna Zimmermannova Telecommunications anna.z@mail.example.com" if i % 10 == 0 else f"{fill(40)} best regards") for i in range(200)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marked = {(r.doc_id, rows[r.doc_id][1][s["start"] : s["stop"]], s["kind"]) for r in got for s in r.spans if s["rank"] >= 4}
    assert marked == {(i, t, pii.REVEAL) for i in range(0, 200, 10) for t in ("Anna", "Zimmermannova", "Telecommunications")}


def test_near_copies_are_one_document(spark):
    rnd = random.Random(7)
    base = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "omega") for b in ("tic", "ness", "ing", "able", "ful", "ism", "ist", "ward")]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(40))) for i in range(100)]
    for i in range(100, 130):  # a word differs beside the address, and one far from it
        text = [*base, "zygote", f"v{'abcdefghijklmnopqrstuvwxyzABCD'[i - 100]}close", "jo@mail.example.com", *base[::-1]]
        text[3] = f"w{'abcdefghijklmnopqrstuvwxyzABCD'[i - 100]}far"
        rows.append((i, " ".join(text)))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 130 and all(s["rank"] < 4 for r in got for s in r.spans)


def test_empty_table(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_a_table_and_its_double_give_the_same(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    spans = lambda frame: {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(frame).collect()}
    once = spans(df)
    assert any(s[1] >= 4 for found in once.values() for s in found)
    assert spans(df.unionByName(df)) == once
    moved = df.unionByName(df.selectExpr("doc_id + 1000 doc_id", "text"))  # copies under other ids
    twice = spans(moved)
    assert {d: s for d, s in twice.items() if d < 1000} == once and {d - 1000: s for d, s in twice.items() if d >= 1000} == once


CLASHES = "_key _rid _spans _row _id _own _blob _found rid id body node text_ spans"


@pytest.mark.parametrize("extra", CLASHES.split())
def test_sanitise_carries_any_column(spark, extra):
    df = spark.createDataFrame([(1, "write to jo@mail.example.com", 7.5), (2, None, None), (2, "", 1.0), (2, "", 1.0)], f"doc_id long, text string, `{extra}` double")
    got = pii.sanitise(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "write to <email>", 7.5), (2, "", 1.0), (2, "", 1.0), (2, None, None)]
