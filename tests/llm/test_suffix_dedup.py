import hashlib
import random
from collections import Counter

import pytest

from tallyforge.llm import suffix_dedup as suffix_module
from tallyforge.llm.runs import repeated_windows
from tallyforge.llm.suffix_dedup import digests, suffix_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    data = [(i, (x or "").encode()) for i, x in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for doc_id, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, longer = text(9), text(40)
    rows = [(i, text(r.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, text(r.randint(0, 9)) + common + text(r.randint(0, 9))) for i in range(40)]
    rows += [(200 + i, longer[: r.randint(20, 200)] + text(3) + longer[r.randint(0, 60) :]) for i in range(25)]
    rows += [(300 + i, rows[i][1]) for i in range(8)] + [(400, "a" * 300), (401, "ab" * 200), (402, None), (403, ""), (None, common), (None, common), (7, "short")]
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 400), (2, 4)])
def test_equals_brute_force(spark, seed, group):
    rows = corpus(seed)
    got = digests(spark.createDataFrame(rows, SCHEMA).repartition(3), length=40, anchor=8, group=group)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 40)


def test_text_and_other_columns(spark):
    x = "one passage that stands in two documents, é and all"
    rows = [(1, "A" + x + "B", "p", 1), (2, x, "q", 2), (3, None, None, None), (4, "x", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup(docs, length=len(x.encode()), anchor=8).collect()}
    assert got == {1: ("AB", "p", 2), 2: ("", "q", 0), 3: (None, None, None), 4: ("x", "s", 1)}


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_equal_brute_force():
    r = random.Random(5)
    for _ in range(100):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        n = r.randint(1, 8)
        seen = Counter(x[i : i + n] for x in texts for i in range(len(x) - n + 1))
        assert [list(x) for x in repeated_windows(texts, n)] == [[seen[x[i : i + n]] > 1 for i in range(len(x) - n + 1)] for x in texts]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_repeated_anchors_joined_and_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_module, "MOST_KEYS", most)
    rows = corpus(4)
    got = digests(spark.createDataFrame(rows, SCHEMA).repartition(3), length=40, anchor=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 40)


def test_a_text_of_very_many_rows_is_dealt_out(spark):
    text = "one text that very many rows hold, long enough to be a passage of its own"
    rows = [(i, text) for i in range(900)] + [(5000 + i, f"own {i} " * 12) for i in range(20)]
    got = {r["doc_id"]: r["n_removed"] for r in digests(spark.createDataFrame(rows, SCHEMA).repartition(5), length=40, anchor=8).collect()}
    assert len(got) == 920 and {got[i] for i in range(900)} == {len(text)}
