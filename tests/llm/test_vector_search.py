import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.vector_search import nearest, usable

SCHEMA = "vec_id long, embedding array<float>, score string"


def run(spark, rows, **how):
    own = usable(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))
    return nearest(own, own.where(F.col("vec_id") % 20 == 0), **how).collect()


def brute(ids, x, top=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = x.astype("f4").astype("f8") @ x[i].astype("f4").astype("f8")
            out[ids[i]] = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != i)[:top]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, (3000, 1))
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], shard_rows=1000)
    want = brute(list(range(3000)), x)
    assert len(got) == 20 * len(want)
    by = {}
    for g in got:
        by.setdefault(g["query_id"], {})[g["rank"]] = g
    hit = 0
    for q, w in want.items():
        own = [by[q][k] for k in range(1, 21)]
        assert all((a["score"], -a["vec_id"]) >= (b["score"], -b["vec_id"]) for a, b in zip(own, own[1:]))
        exact = {v: -s for s, v in w}
        for g in own:
            assert g["vec_id"] not in exact or math.isclose(g["score"], exact[g["vec_id"]], rel_tol=1e-12, abs_tol=1e-12)
        hit += len(exact.keys() & {g["vec_id"] for g in own})
    assert hit >= 0.95 * len(got)


def recall(got, want):
    by = {}
    for g in got:
        by.setdefault(g["query_id"], set()).add(g["vec_id"])
    assert all(len(by.get(q, ())) == 20 for q in want)
    return sum(len(by[q] & {v for _, v in w}) for q, w in want.items()) / (20 * len(want))


@pytest.mark.parametrize("lengths", ["one long", "one very long", "log-normal", "huge"])
def test_lengths_may_differ(spark, lengths):
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 32))
    if lengths == "log-normal":
        x *= np.exp(r.normal(0, 2, (3000, 1)))
    elif lengths == "huge":
        x = x[:60]
        x[7], x[8] = 1e25, 2e25
    else:
        x[1234] *= 100 if lengths == "one long" else 1_000_000
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], shard_rows=1024, graph_rows=512)
    assert recall(got, brute(list(range(len(x))), x)) >= 0.95


def test_ties_copies_and_broken_vectors(spark):
    good = [(i, [1.0, 0.0]) for i in range(100, 140)] + [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (41, [0.0, 1.0])]
    bad = [(0, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1.0, 2.0, 3.0]), (None, [9.0, 9.0])]
    got = run(spark, good + bad)
    assert {g["query_id"] for g in got} == {20, 100, 120}
    first = sorted((g["rank"], g["vec_id"]) for g in got if g["query_id"] == 100)
    assert [v for _, v in first] == [20, 20, *range(101, 119)]
    assert sorted(g["vec_id"] for g in got if g["query_id"] == 20) == sorted(2 * [20, *range(100, 119)])


def test_fewer_candidates_than_asked_and_none(spark):
    got = run(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1.0, 0.0])])
    assert [(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got] == [(0, 1, 1, 5.0), (0, 2, 2, -1.0)]
    assert run(spark, []) == [] == run(spark, [(0, [1.0])])
