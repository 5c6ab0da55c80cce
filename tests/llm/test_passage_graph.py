import hashlib
import random
import re

import pytest

from tallyforge.llm import passage_graph
from tallyforge.llm.passage_graph import digests, repeated_spans, substring_dedup, unequal_spans

SCHEMA = "doc_id long, text string"


def brute(rows, size):
    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in rows]
    least = {}
    for i, w in own:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in own:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: r.choice([" ", "\n", "  ", "\t"]).join(r.choice("a b c d é die der und".split()) + r.choice(["", str(r.randint(0, 30))]) for _ in range(n))
    common, longer = text(12), text(60)
    cut = lambda: " ".join(longer.split()[r.randint(0, 20) : r.randint(25, 60)])
    rows = [(i, text(r.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, f"{text(r.randint(0, 9))} {common}\n{text(r.randint(0, 9))}") for i in range(40)]
    rows += [(r.randint(0, 300), f"{cut()} {text(3)} {cut()}") for _ in range(40)]
    rows += [(300 + i, rows[i][1]) for i in range(8)] + [rows[5], rows[5], (400, "a " * 90), (401, "a " * 60), (402, "a b " * 50), (403, "b a b " * 40)]
    rows += [(404, None), (405, ""), (None, common), (None, longer), (-3, longer), (7, "short"), (406, longer + " end \x1c " + longer)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "most", "block"), [(1, 1_000_000, 1_000_000), (2, 0, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, most, block):
    monkeypatch.setattr(passage_graph, "MOST_KEYS", most)
    monkeypatch.setattr(passage_graph, "BLOCK_BYTES", block)
    monkeypatch.setattr(passage_graph, "BLOCK_WINDOWS", block)
    rows = corpus(seed)
    got = digests(spark.createDataFrame(rows, SCHEMA).repartition(3), size=10, anchor=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10)


def test_text_and_other_columns(spark):
    x = "one passage that stands in two documents"
    rows = [(1, x + " \n first", "p", 1), (2, "Then " + x + " and more", "q", 2), (3, None, None, None), (4, "a  b", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(docs, size=7, anchor=3).collect()}
    assert got == {1: (x + " \n first", "p", 16 + len(x) - 8), 2: ("Then and more", "q", 13), 3: (None, None, None), 4: ("a  b", "s", 4)}


def keyed(spark, rows):
    return spark.createDataFrame([(i, hash(x), bytearray(x.encode())) for i, x in rows], "doc_id long, k1 long, bytes binary")


def test_long_passages_are_one_span_and_false_ones_are_refuted(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "before " + passage), (2, passage + " after"), (3, "something else " + passage)]
    docs = keyed(spark, rows)
    spans = repeated_spans(docs, 50, 20)
    assert sorted((x["doc_id"], x["lo"], x["n"], x["s_doc"], x["s_at"]) for x in spans.collect()) == [(2, 0, 351, 1, 1), (3, 2, 351, 1, 1)]
    false = spans.selectExpr("doc_id", "k1", "lo", "n", "s_doc", "s_k1", "IF(doc_id = 3, s_at - 1, s_at) AS s_at")
    assert [(x["doc_id"], x["lo"]) for x in unequal_spans(docs, false, 50).collect()] == [(3, 2)]


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).collect() == []
