import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import resampling
from tallyforge.llm.resampling import _advance, _applied, op13_importance_resampling, resample, scores

SCHEMA = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = (Counter(b for text in x for b in features(text)[1]) for x in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        w, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in rows if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in rows), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "data", "x", "é", "straße", "ÉTÉ", "don't", "a-b", "42", "naïve_case", "日本語", "w" * r.randint(1, 400), "q" + str(r.randint(0, 60))])
    text = lambda n: r.choice([" ", "\n", ", "]).join(word() for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 2, 3, 19, 20, 21, 60, 200]))) for i in range(150)]
    rows += [(i, rows[i][1]) for i in range(20)] + [(900, None), (901, ""), (None, text(30)), (None, None), (902, "...")]
    return rows, [text(40) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize(("seed", "block", "piece"), [(1, 400_000, 2_000_000), (2, 7, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, block, piece):
    monkeypatch.setattr(resampling, "BLOCK_WORDS", block)
    monkeypatch.setattr(resampling, "PIECE_BYTES", piece)
    rows, target = corpus(seed)
    docs, wanted = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(x,) for x in target], "text string")
    assert sorted((tuple(x) for x in scores(docs, wanted).collect()), key=str) == brute(rows, target)


def test_blocks_of_few_words_equal_one_block(monkeypatch):
    rows, _ = corpus(3)
    texts = [x for _, x in rows]
    want = Counter(b for x in texts for b in features(x)[1])
    for size in (1, 2, 5, 400_000):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", size)
        found = sum(block.counts(10000) for _, _, block in resampling.blocks(texts, 10000))
        assert {b: n for b, n in enumerate(found.tolist()) if n} == want


def test_crcs_are_strung_together():
    r = random.Random(5)
    for n in (1, 2, 3, 7, 8, 100, 4097):
        a, b = r.randbytes(9), r.randbytes(n)
        assert int(_applied(_advance(n), np.array([zlib.crc32(a)], "u4"))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_drawn_documents_come_whole(spark):
    rows, target = corpus(4)
    docs = spark.createDataFrame([(i, x, "own", k) for k, (i, x) in enumerate(rows)], SCHEMA + ", rank string, score int")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    drawn = resample(docs, wanted).collect()
    assert docs.columns[:2] + ["score", "rank"] == list(drawn[0].asDict())
    want = sorted((r, i) for i, _, _, _, r in brute(rows, target) if r)
    assert sorted((x["rank"], x["doc_id"]) for x in drawn) == want
    assert all(rows[x["score"]] == (x["doc_id"], x["text"]) for x in drawn)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a " * 30)], SCHEMA)
    assert scores(empty, some).collect() == []
    assert [x["n_features"] for x in scores(some, empty).collect()] == [87]


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [x[0] for x in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    found = op13_importance_resampling(spark, folder).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, target)
