import itertools

import numpy as np
import pytest

from quirefold.llm import langid as L


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 7, size=5)
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got = L.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        value = lambda path: sum(part[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(tuple(got[at : at + n])) == pytest.approx(value(best))
        at += n


def test_scripts():
    assert [L.scripts(np.array([ord(c)]))[0] for c in "aéαжא漢あ한"] == [0, 0, 1, 2, 4, 13, 12, 11]
    assert L.scripts(np.array([0x1F600]))[0] == L.OTHER


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.learn(docs.where(~L.is_held_out()))
    assert set(model.languages) == {"en", "fr", "de", "es"}
    rows = L.identify(docs, model, spans=False).join(docs.where(L.is_held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 2000
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    en = "the cat and the dog were in the house with their friends when it began to rain over the town"
    fr = "le chat et le chien sont dans la maison avec leurs amis quand il commence une pluie sur la ville"
    ru = "кошка и собака были в доме с друзьями когда начался дождь над городом"
    rows = [(i, t, k) for i in range(20) for t, k in ((en, "en"), (fr, "fr"), (ru, "ru"))] + [(99, "x", None), (98, None, "zz"), (97, "123", "nn")]
    return L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_a_mixed_text(spark, model):
    assert model.languages == ("en", "fr", "ru")
    text = "The cat and the dog were in the house, 12 friends. Le chien et la maison sont dans la ville avec leurs amis! Кошка и собака начался город"
    row = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(s.lang) for s in row.spans] == ["en", "fr", "ru"]
    assert [text[s.start : s.stop].split()[0] for s in row.spans] == ["The", "Le", "Кошка"]
    assert row.spans[-1].stop == len(text)


def test_script_narrows_candidates(model):
    assert model.scores(["дом"])[0].argmax() == 2 and model.scores(["дом"])[0].min() == -2 * L.WORD_LIMIT


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the house"), (4, "la maison"), (None, "the house"), (5, "the " * 50_000), (6, "x" * 100_000), (7, "漢字"), (8, "house 42 \u0000 the")]
    df = spark.createDataFrame([(*r, "q", 2.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted(map(tuple, L.identify(df, model, spans=False).collect()), key=str)
    assert len(got) == len(rows)
    for want in ((1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (4, "fr", 1.0), (None, "en", 1.0), (5, "en", 1.0)):
        assert want in got
    assert L.identify(df.limit(0), model).count() == 0
    assert L.learn(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id long, text string, lang string")) is None
    assert {tuple(r)[1:3] for r in L.identify(df, None).collect()} == {("und", 0.0)}


def test_decoding_in_portions_changes_nothing(spark, model, monkeypatch):
    texts = ["the cat la maison", "", "le chien " * 30, "дождь", None, "the town"]
    whole = [x[1].tolist() for x in L._labelled(texts, L._Words(model))]
    monkeypatch.setattr(L, "CELLS", 20)
    monkeypatch.setattr(L, "CACHE_CELLS", 60)
    assert [x[1].tolist() for x in L._labelled(texts, L._Words(model))] == whole


def test_long_texts_are_decoded_piece_by_piece(model, monkeypatch):
    rng = np.random.default_rng(2)
    words = "the cat house le chien maison дождь над 12 !!".split()
    texts = [" ".join(rng.choice(words, size=n)) for n in (200, 1000, 3000)] + ["\t".join(["the"] * 400 + ["chien"] * 400)]
    whole = [(real.tolist(), labels.tolist()) for real, labels in L._labelled(texts, L._Words(model))]
    monkeypatch.setattr(L, "PIECE", 90)
    assert [(real.tolist(), labels.tolist()) for real, labels in L._labelled(texts, L._Words(model))] == whole
    assert "".join(piece for _, piece in L._pieces(texts[1])) == texts[1]


def test_spans_end_where_runs_do(model):
    text = "12 the, house 7 le chien! 9"
    got = L._spans(text, np.array([False, True, True, False, True, True, False]), np.array([0, 0, 0, 0, 1, 1, 1]), ("en", "fr"))
    assert [(text[s["start"] : s["stop"]], s["lang"]) for s in got] == [("the, house", "en"), ("le chien!", "fr")]
    assert L._spans("12", np.array([False]), np.array([0]), ("en",)) == []


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 3 + " word", f"l{i:03}") for i in range(300)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    got = L.identify(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03}" for r in got) > 290
