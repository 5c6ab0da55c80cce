import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.quality import L1, fit, grade, rating, train

WORDS = {0: ["spam", "click", "buy"], 1: ["hate", "vile", "curse"], 2: ["theorem", "river", "music"]}


def corpus():
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        g = r.choice([0, 1, 2, 2])
        rows.append((i, " ".join(r.choice(WORDS[g] + ["the", "of"]) for _ in range(r.randint(5, 40))), "x"))
        labels.append((i, 0 if g == 0 else 1, 1 if g == 1 else 0))
    return rows, labels


def test_grades_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade"))
    model = train(docs, rated.where("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    truth = {i: 0 if not q else 1 if t else 2 for i, q, t in labels}
    got = grade(docs, model).where("doc_id % 4 = 0").collect()
    assert sum(r["selected"] == (truth[r["doc_id"]] == 2) for r in got) >= 0.95 * len(got)
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 and r["grade"] == "x" for r in got)


def test_odd_rows_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 5000), (2, "x " * 5000)], "doc_id long, text string")
    model = train(docs, none)
    out = grade(docs, model).collect()
    assert len(out) == 4 and {round(r["tail_probability"], 6) for r in out} == {round(1 / 3, 6)}
    assert grade(docs.limit(0), model).collect() == []


def test_repeated_ratings_count_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 2}") for i in range(20)], "doc_id long, text string")
    once = [(i, 2 * (i % 2)) for i in range(20)]
    a = train(docs, spark.createDataFrame(once, "doc_id long, grade int"))
    b = train(docs, spark.createDataFrame(once + once + [(None, 1), (3, None)], "doc_id long, grade int"))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


@pytest.mark.parametrize("n_grades", [2, 4])
def test_scores_follow_grades(n_grades):
    r = np.random.default_rng(1)
    grades = r.integers(0, n_grades, 300)
    model = fit([np.array([7, 100 + g], "int32") for g in grades], grades, np.ones(300), n_grades)
    assert (np.diff(model.weights[100 : 100 + n_grades]) > 0).all()


def objective(weights, thresholds, features, grades, importance):
    """Negative weighted log-likelihood a document, plus the penalty, written out one document at a time."""
    loss = 0.0
    for f, g, i in zip(features, grades, importance / importance.sum()):
        s = weights[f].sum()
        tail = [1.0, *(1 / (1 + np.exp(t - s)) for t in thresholds), 0.0]
        loss -= i * np.log(max(tail[g] - tail[g + 1], 1e-12))
    return loss + L1 * np.abs(weights).sum()


def test_fit_is_near_the_optimum_of_the_plain_likelihood():
    r = np.random.default_rng(3)
    truth = r.normal(0, 1.5, 12)
    features = [np.flatnonzero(r.random(12) < 0.4).astype("int32") for _ in range(400)]
    score = np.array([truth[f].sum() for f in features]) + r.logistic(size=400)
    grades, importance = np.digitize(score, [-0.5, 1.0]), r.uniform(0.5, 2, 400)
    model = fit(features, grades, importance, 3)
    weights, thresholds = model.weights[:12].copy(), model.thresholds.copy()
    reached = objective(weights, thresholds, features, grades, importance)
    best, step = (weights, thresholds), 0.3
    least = reached
    for _ in range(60):  # plain coordinate search from there
        better = False
        for which in range(2):
            for k in range(len(best[which])):
                for d in (step, -step):
                    trial = [best[0].copy(), best[1].copy()]
                    trial[which][k] += d
                    value = objective(*trial, features, grades, importance) if trial[1][0] <= trial[1][1] else np.inf
                    if value < least:
                        best, least, better = tuple(trial), value, True
        step = step if better else step / 2
    assert reached - least < 0.002
    start = objective(np.zeros(12), -np.log([2.0, 0.5]), features, grades, importance)
    assert reached < start - 0.1


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "x", "old", 5.0, True)], "doc_id long, text string, expected_grade string, tail_probability double, selected boolean")
    out = grade(docs, train(docs, spark.createDataFrame([], "doc_id long, grade int")))
    assert out.columns == ["doc_id", "text", "expected_grade", "tail_probability", "selected"]
    assert out.first()["expected_grade"] == pytest.approx(1.0)


def test_held_out_ratings_of_the_label_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = docs.join(labels, "doc_id").select("doc_id", "text", "grade")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    model = train(docs, labels.where(~fold))
    got = grade(rated.where(fold), model).select("grade", "selected").collect()
    right = sum((r["grade"] == 2) == r["selected"] for r in got) / len(got)
    most = max(sum(r["grade"] == 2 for r in got), sum(r["grade"] != 2 for r in got)) / len(got)
    assert len(got) > 80 and right >= 0.85 and right > most
