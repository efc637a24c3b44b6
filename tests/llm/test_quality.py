import numpy as np
import pytest

from quirefold.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = quality.train(docs, seen)
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.grade(docs, model)
    assert got.count() == docs.count()
    rows = got.join(held, "doc_id").withColumn("grade", quality.grade_of(held["quality"], held["toxic"])).collect()
    kept = {g: np.mean([r.kept for r in rows if r.grade == g]) for g in (0, 1, 2)}
    mean = {g: np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[1] < 0.1 and kept[0] < 0.3, kept
    assert mean[0] < mean[1] < mean[2]
    assert all(r.p_not_toxic >= r.p_good for r in rows)
    chosen = quality.select(docs, model)
    assert chosen.columns == docs.columns and chosen.count() == got.where("kept").count()


def test_fit_finds_the_gradient_of_the_likelihood():
    """On a small problem the fit comes close to a brute-force search over weight and thresholds."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.digitize(x + rng.logistic(size=400) * 0.5, [-1.0, 1.0])
    model = quality.fit([np.array([7], dtype=np.int32)] * 400, [np.array([v], dtype=np.float32) for v in x], y, 3)

    def loss(w, a, b):
        f = lambda t: 1 / (1 + np.exp(-(t - w * x)))
        p = np.where(y == 0, f(a), np.where(y == 1, f(b) - f(a), 1 - f(b)))
        return -np.log(p).mean()

    grid = min(loss(w, a, b) for w in np.arange(0.5, 4, 0.1) for a in np.arange(-4, 0, 0.1) for b in np.arange(0, 4, 0.2))
    assert loss(model.weights[7], *model.thresholds) < grid + 0.005


@pytest.mark.parametrize("labels", [[], [(1, None, 0), (None, 1, 0)]])
def test_without_labels_all_is_kept(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model is None
    assert [tuple(r) for r in quality.grade(docs, model).orderBy("doc_id").collect()] == [(1, None, None, None, True), (2, None, None, None, True)]


def test_edge_cases(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (None, "stray " * 30_000), (1, "good words here"), (4, "!!! ???")]
    docs = spark.createDataFrame([(*r, 1.0, "g") for r in rows], "doc_id long, text string, kept double, grade string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.grade(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.p_good <= r.p_not_toxic <= 1 for r in got)
    assert quality.select(docs, model).columns == docs.columns
    assert quality.grade(docs.limit(0), model).count() == 0


def test_shapes_of_whole_words():
    assert quality._shape("Ab12--x") == "Aa0Ra" and quality._shape("!!??!!") == "RRR"
    assert quality._shape("a" * 100 + "1") == "a0" != quality._shape("a" * 101)
    quality._shape("!!??" * 250_000)  # in linear time


def test_grades_equal_the_formula(spark):
    """Every number of grade() from the weights and thresholds, summed bucket by bucket."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    for r in docs.collect():
        score = sum(float(model.weights[b]) * float(v) for b, v in zip(*quality.features(r.text)))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        mine = got[r.doc_id]
        assert (mine.p_not_toxic, mine.p_good) == pytest.approx(tuple(tails), abs=1e-4)
        assert mine.expected_grade == pytest.approx(sum(tails), abs=2e-4)
        assert mine.kept == (mine.p_good >= quality.KEEP)


def test_features_taken_to_the_driver_are_bounded(spark):
    docs = spark.range(50).selectExpr("id doc_id", "concat('common words here ', id) text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic")
    assert quality.train(docs, labels, most_features=100) is not None and quality.train(docs, labels, most_features=1) is not None


def test_fit_in_blocks_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 50, size=n).astype(np.int32), rng.normal(size=n).astype(np.float32)) for n in rng.integers(1, 9, size=200)]
    y = rng.integers(0, 3, size=200)
    fit = lambda: quality.fit([b for b, _ in rows], [v for _, v in rows], y, 3)
    whole = fit()
    monkeypatch.setattr(quality, "BLOCK", 40)
    assert np.allclose(fit().weights, whole.weights, atol=1e-3)
