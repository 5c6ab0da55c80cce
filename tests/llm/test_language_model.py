import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import language_model as lm
from tallyforge.llm.common import bytes_of

SCHEMA = "doc_id long, text string, held_out boolean"


def corpus():
    r = random.Random(2)
    kinds = [f"w{i}" for i in range(30)] + ["É", "The", "THE", "the", "x y"]
    rows = [(i, " ".join(r.choice(kinds) for _ in range(r.randint(0, 40))), zlib.crc32(str(i).encode()) % 7 == 2) for i in range(120)]
    return rows + [(200, None, False), (200, None, False), (201, "", True), (None, "\t the\x0b\n", True), (202, "never seen", True), ((1 << 60) + 1, "w1 w2 " * 3000, False)]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def trained(docs, **parameters):
    return lm.train(docs.where("not held_out").select(bytes_of(F.col("text")).alias("bytes")), **parameters)


def level(c):
    return 1 + int(math.log(c) / math.log(lm.BASE) + 1e-9) if c else 0


def brute(rows):
    """Base score and score of each row, from plain dictionaries of rounded counts."""
    seen, runs = Counter(), Counter()
    for _, x, held in rows:
        if not held:
            own = tokens(x)
            seen.update(own)
            runs["start"] += 1
            own = ["start", *own]
            runs.update(zip(own, own[1:]))
            runs.update(zip(own, own[1:], own[2:]))
    n, v = sum(seen.values()), len(seen)
    low = lambda c: math.ceil(lm.BASE ** (level(c) - 1) - 1e-9) if c else 0
    high = lambda c: math.ceil(lm.BASE ** level(c) - 1e-9) - 1 if c else 0
    lean = lambda p, c, h: (min(low(c), high(h)) + lm.STRENGTH * p) / (high(h) + lm.STRENGTH) if h else p
    out = []
    for doc_id, x, held in rows:
        own, total = tokens(x), 0.0
        line = ["start", *own]
        for i, t in enumerate(own):
            p = lean((low(seen[t]) + 1) / (n + v + 1), runs[line[i], t], seen[line[i]] if i else runs["start"])
            if i:
                p = lean(p, runs[line[i - 1], line[i], t], runs[line[i - 1], line[i]])
            total += math.log10(p)
        base = sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in own)
        out.append((doc_id, held, len(own), sum(seen[t] > 0 for t in own), n, round(base, 6), round(total, 6)))
    return sorted(out, key=str)


def plain(found):
    return sorted(((*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(r["base_score"], 6), round(r["score"], 6)) for r in found.collect()), key=str)


@pytest.mark.parametrize("most_bytes", [lm.MOST_BYTES, 0])
def test_scores_equal_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(lm, "PACK_BYTES", 500)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = trained(docs, most_bytes=most_bytes, bits_per_entry=200)  # next to no false positives
    assert (model.parts is None) == (most_bytes == 0)
    got, want = plain(lm.score(docs, model)), brute(rows)
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert sum(abs(x[6] - y[6]) < 1e-5 for x, y in zip(got, want)) >= len(rows) - 2


def test_a_model_too_large_to_broadcast_scores_alike(spark, monkeypatch):
    monkeypatch.setattr(lm, "PACK_BYTES", 500)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    r = random.Random(5)
    rows = corpus() + [(300 + i, " ".join(f"v{r.randint(0, 3000)}" for _ in range(300)), i % 5 == 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole, apart = trained(docs), trained(docs, most_bytes=0)
    assert len(whole.parts) > 3 and apart.parts is None
    assert plain(lm.score(docs, apart)) == plain(lm.score(docs, whole))


def test_filter_reads_back_rounded_counts():
    r = np.random.default_rng(1)
    regions = lm.Regions(6)
    gram = regions.narrow(np.unique((r.integers(0, 2**58, 20_000).astype("u8") * np.uint64(2)) & np.uint64((1 << 58) - 1)))
    n = r.integers(1, 2000, len(gram))
    bits = lm.fill(gram, n).tobytes()
    part = lm.part_of([{"region": 0, "bits": bits, "words": b"", "counts": b""}], 0, 0)
    got = part.levels(gram, regions)
    assert (got >= lm.levels_of(n)).all() and (got == lm.levels_of(n)).mean() > 0.9
    other = np.unique(r.integers(0, 2**58, 20_000).astype("u8"))
    assert (part.levels(other, regions) == 0).mean() > 0.9
    assert 0.9 < len(bits) * 8 / (lm.levels_of(n).sum() * lm.BITS_PER_ENTRY) < 1.1


@pytest.mark.parametrize("bits", [6, 15, 16, 20])
def test_grams_come_back_from_six_bytes(bits):
    regions = lm.Regions(bits)
    gram = np.sort(regions.narrow(np.random.default_rng(2).integers(0, 2**63, 3000).astype("u8") * np.uint64(2) + np.uint64(1)))
    region, at = regions.split(gram)
    back = [regions.unpacked(regions.packed(gram[i:j]), int(r)) for r, i, j in zip(region, at, at[1:])]
    assert (np.concatenate(back) == gram if bits <= 16 else np.concatenate(back) >> np.uint64(64 - bits) == gram >> np.uint64(64 - bits)).all()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_held_out_texts_score_better_than_by_words_alone(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").select("doc_id", "text", (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2).alias("held_out"))
    got = lm.score(docs, trained(docs)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.1


def test_runs_seen_once_are_known(spark):
    kinds = [f"k{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(kinds), False), (2, " ".join(kinds[::-1]), True)], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, trained(docs)).collect()}
    assert got[1] > got[2] + 200  # ten times as likely a word on average


def test_words_after_a_history_sum_to_one_at_most(spark):
    docs = spark.createDataFrame([(i, f"a b a c a d {i % 3}", False) for i in range(50)], SCHEMA)
    model = trained(docs)
    own = model.at_hand()
    def score(text, k):
        token = lm.tokens([text])[0][:k]
        return lm.model_score(token, np.array([k]), own.counts(token), own.levels, model.n_tokens, model.n_words)[0]

    for history in (b"a", b"b a", b"d"):
        k = len(history.split())
        total = sum(10 ** (score(history + b" " + x, k + 1) - score(history, k)) for x in (b"a", b"b", b"c", b"d", b"0", b"1", b"2", b""))
        assert 0.3 < total <= 1.0 + 1e-9  # counts of histories are rounded up


def test_nothing_to_learn_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lm.train(none.select(bytes_of(F.col("text")).alias("bytes")))
    assert lm.score(none, model).collect() == []
    row = lm.score(spark.createDataFrame([(1, "a b", True)], SCHEMA), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_large_models_are_asked_by_few_shards(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = trained(docs, most_bytes=0)
    rows = docs.select("doc_id", "held_out", bytes_of(F.col("text")).alias("bytes"))
    answered = lm._with_answers(rows, model).select(F.size("parts").alias("n")).collect()
    assert max(r["n"] for r in answered) == 1  # 64 small regions, asked together
    fields = ["n_tokens", "n_known", "base_score", "score"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["held_out"])
    told = lambda m: [tuple(r[f] for f in fields) for r in sorted(lm.score(docs, m).collect(), key=key)]
    want = told(trained(docs))
    for size in (model.n_bytes // 5, model.n_bytes // 500):  # shards of several regions, and of one
        monkeypatch.setattr(lm, "SHARD_BYTES", size)
        assert all(a == pytest.approx(b) for a, b in zip(told(model), want, strict=True))
