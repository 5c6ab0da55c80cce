import random

import pytest

from tallyforge.llm.components import connected_components
from tallyforge.llm import near_dedup as module
from tallyforge.llm.near_dedup import LONGEST, chance, depth_for, forest_links, near_dedup, ngram_join

SCHEMA = "doc_id long, text string, class string"


def brute(rows):
    sets = {}
    for _, x, _ in rows:
        w = (x or "").split()
        sets[x or ""] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    texts = sorted(sets)
    linked = {a: {b for b in texts if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in texts}
    root, out = {}, []
    for a in texts:
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = a
                todo += linked[x]
    least = {}
    for i, x, _ in rows:
        r = root[x or ""]
        ids = [y for y in (least.get(r), i) if y is not None]
        least[r] = min(ids) if ids else None
    for i, x, _ in rows:
        out.append((i, least[root[x or ""]], len(linked[x or ""])))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    text = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    rows = [(i, " ".join(text(r.randint(0, 120))), "x") for i in range(80)]
    for base, copies in ((0, 40), (1, 5), (2, 3)):
        own = text(120 + base)
        for k in range(copies):
            edited = own[:]
            for _ in range(r.randint(0, 4)):
                edited[r.randrange(len(own))] = "edit"
            rows.append((1000 + 100 * base + k, " ".join(edited), None))
    return rows + [(7, rows[3][1], None), (7, rows[3][1], None), (None, rows[90][1], None), (5000, None, None), (5001, "", None), (5002, "a b", None), (5003, "a  b", None), (None, " \n ", None)]


@pytest.mark.parametrize("group_texts", [2048, 16])
def test_equals_brute_force(spark, group_texts):
    rows = corpus()
    got = ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(3), group_texts=group_texts)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_blocks_without_texts_add_no_links(spark):
    rows = corpus()
    got = ngram_join(spark.createDataFrame(rows, SCHEMA), group_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    got = [r["doc_id"] for r in near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = {c for _, c, _ in brute(rows)}
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns_are_kept(spark):
    rows = [(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6), (3, None, None, None)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string, keep_id string, keep_node long"))
    assert got.columns == ["doc_id", "text", "keep_id", "keep_node"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", "x", 5), (3, None, None, None)]


def test_links_are_those_of_the_tries(spark, monkeypatch):
    r = random.Random(9)
    rows = [(t, bytes(x for _ in range(LONGEST) for x in (0, int(r.random() < 0.3))), i.to_bytes(16)) for t in range(3) for i in range(200)]
    rows += [(1, b"\0" * 2 * LONGEST, (500 + i).to_bytes(16)) for i in range(300)]  # a label that many share
    monkeypatch.setattr(module, "SORT_ROWS", 100)
    got = forest_links(spark.createDataFrame(rows, "tree int, label binary, node binary")).collect()

    def classes(links):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return {x: find(x) for x in list(root)}

    labels = {(t, n): x for t, x, n in rows}
    for tree in range(3):
        for depth in (8, 5, 3):
            by = {}
            for t, x, n in rows:
                if t == tree:
                    by.setdefault(x[: 2 * depth], []).append(n)
            want = {n: own[0] for own in by.values() if len(own) > 1 for n in own}
            found = [(bytes(x["a"]), bytes(x["b"])) for x in got if x["tree"] == tree and x["depth"] >= depth]
            assert all(labels[tree, a][: 2 * depth] == labels[tree, b][: 2 * depth] for a, b in found)
            own = classes(found)
            assert own.keys() == want.keys() and len(set(own.values())) == len(set(want.values()))


def test_recall_at_the_threshold(spark):
    rows = []
    for k in range(150):  # pairs just above the threshold: 104 shingles, 11 of each text's own
        own = [f"v{k}.{i}" for i in range(108)]
        rows += [(2 * k, " ".join(own), ""), (2 * k + 1, " ".join([*own[:-11], *(f"o{k}.{i}" for i in range(11))]), "")]
    got = {x["doc_id"]: x["n_links"] for x in ngram_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got.values()) >= 0.99 * len(rows)
    assert chance(depth_for()) >= 0.9999 > chance(depth_for() + 1)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_prefixes_are_shortened_as_long_as_that_finds_more(spark):
    from tallyforge.llm.near_dedup import adapted_links

    texts = [" ".join(f"{g}w{i}" for i in range(40)) for g in range(3)]
    rows = [(bytes([g]), 0, bytearray(x.encode())) for g, x in enumerate(texts)] + [(bytes([10 + g]), 0, bytearray((x + " end").encode())) for g, x in enumerate(texts)]
    own = spark.createDataFrame(rows, "node binary, row long, bytes binary")
    link = lambda *x: (bytearray([x[0]]), bytearray([x[1]]), x[2])
    # 0 and 10 meet at once; 1 and 11 only when prefixes are one value shorter; 2 and 12 would two values shorter, but then nothing similar was found at one
    for links_, joined in (([link(0, 10, 8), link(1, 11, 4)], {0, 1}), ([link(0, 10, 8), link(1, 2, 4), link(2, 12, 3)], {0}), ([link(0, 10, 8), link(1, 11, 4), link(2, 12, 3)], {0, 1, 2})):
        met = spark.createDataFrame(links_, "a binary, b binary, depth int")
        parts = adapted_links(met, own, own, 5, 0.8, 24, 0.9999).collect()
        roots = {bytes(r["node"])[0]: bytes(r["root"]) for r in parts}
        assert {g for g in range(3) if g in roots and roots[g] == roots.get(10 + g)} == joined


def test_all_links_are_compared(spark):
    """One similar pair among 5,000 is found, wherever it stands."""
    words = lambda k: " ".join(f"{k}w{i}" for i in range(30)).encode()
    rows = [(f"{k:016d}".encode(), k, words(k)) for k in range(5000)] + [(b"copy", 5000, words(77) + b" more")]
    texts = spark.createDataFrame(rows, "node binary, row long, bytes binary").repartition(4).cache()
    pairs = [(rows[k][0], rows[(k + 1) % 5000][0]) for k in range(5000)]
    for more, n in (([], 0), ([(rows[77][0], b"copy")] * 2, 1)):
        found = module.similar_pairs(spark.createDataFrame(pairs + more, "a binary, b binary"), texts, texts.select("node", "row"), 5, 0.8)
        assert found == n
