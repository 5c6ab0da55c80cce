from collections import Counter

from tallyforge.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, line string"


def brute(rows, ratio, floor, least):
    pages, lines = Counter(), Counter()
    for _, text, _, source, *_ in rows:
        pages[source] += 1
        for x in set((text or "").split("\n")):
            if x.strip(" ") and text is not None:
                lines[source, x] += 1
    out = []
    for doc_id, text, _, source, *_ in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        own = text.split("\n")
        kept = [x for x in own if not (lines[source, x] >= least and lines[source, x] > max(ratio * pages[source], min(0.5 * pages[source], floor)))]
        out.append((doc_id, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def rows():
    out = [(i, f"menu\nown line {i}\n\nfooter {i % 3}\nmenu", "en", "a" if i % 3 else None, 9, "h", "l") for i in range(40)]
    out += [(100, None, None, "a", None, None, None), (101, "", None, "a", 0, None, None), (None, "menu", None, "b", 4, None, None), (5, "menu\n \n", None, "b", 1, None, None), (5, "menu\n \n", None, "b", 1, None, None)]
    return out


def test_equals_brute_force(spark):
    for ratio, floor, least in ((0.1, 10, 3), (0.3, 5, 2), (0.99, 0, 1)):
        for most in (500_000, 0):  # boilerplate sent to all tasks, and joined
            got = line_dedup(spark.createDataFrame(rows(), SCHEMA).repartition(3), ratio, floor, least, most)
            assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute(rows(), ratio, floor, least)


def test_the_ratio_decides_on_hosts_of_every_size(spark):
    pages = [(100 * n + i, f"menu {n}\nsome {n}.{i // 2}\nown {n}.{i}", "en", f"host{n}", 1, "", "") for n in (1, 2, 4, 8, 40) for i in range(n)]
    pages = [(d, x + ("\nfifth" if d >= 4000 and d % 100 < 5 else ""), *rest) for d, x, *rest in pages]
    docs = spark.createDataFrame(pages, SCHEMA)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup(docs).collect()}
    # what two of up to 19 pages share exceeds a tenth of them, as does what 5 of 40 do; 2 of 40 don't
    assert got == {100 * n + i: {1: 0, 40: 1 + (i < 5)}.get(n, 2) for n in (1, 2, 4, 8, 40) for i in range(n)}
    floored = {r["doc_id"]: r["n_dropped"] for r in line_dedup(docs, floor=5, least_pages=3).collect()}
    assert floored == {100 * n + i: int(n >= 4) for n in (1, 2, 4, 8, 40) for i in range(n)}


def test_very_long_text_and_blank_lines(spark):
    own = "\n".join(f"line {i} " + "x" * 60 for i in range(20_000))
    pages = [(i, f"menu\n\t\n  \n{own if i == 0 else i}", "en", "a", 1, "", "") for i in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[0] == "  \n" + own and got[3] == "  \n3"  # a line with a tab isn't blank


def test_texts_are_not_shuffled(spark):
    plan = line_dedup(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
