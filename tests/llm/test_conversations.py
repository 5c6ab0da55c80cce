import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tallyforge.llm.conversations import cheapest_edits, damage, op11_conversation_repair, repair, report

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute_edits(rows):
    """Cost, audit and repaired turns by uniform-cost search over whole audits; rows are (role, text, fault)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, turns = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, [f"{r}:{t}" for r, t in turns]
        if (i, roles, audit) in seen or not any(re.fullmatch("(s?(ua)+)?", roles + x) for x in ("", "a", "ua")):
            continue
        seen.add((i, roles, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, roles + role[0], (*turns, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, roles + new[0], (*turns, (new, text))))


def brute(table):
    groups = {}
    for conv, turn, role, text in table:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        judged, earlier = [], set()
        for _, role, text in own:
            bare = text.strip(SPACE)
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in earlier else "truncated" if bare[-1] not in ".!?" else None))
            earlier.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, left = brute_edits(judged)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in itertools.pairwise(own))
        faults = [sum(f == name for _, _, f in judged) for name in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    found = report(repair(damage(spark.createDataFrame(rows, SCHEMA).repartition(3)))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "unknown"], ["Hi.", "What?", "no end", "", None, " \t", "é!", "ok. \n", "\xa0", "x" * 5000 + "."]
    rows = [(conv, r.choice([k, k, 2 * k, None, 3]), r.choice(roles[:3] * 4 + roles), r.choice(texts)) for conv in [*range(60), None] for k in range(r.randint(1, 5))]
    assert got(spark, rows) == brute(rows)


def test_edits_of_odd_rows(spark):
    assert cheapest_edits(b"") == (0, b"")
    assert cheapest_edits(bytes([1])) == (2, b"D")  # a system row alone
    assert cheapest_edits(bytes([1, 2, 3])) == (0, b"KKK")
    assert cheapest_edits(bytes([2])) == (2, b"D")  # deleting is cheaper than an answer
    assert cheapest_edits(bytes([2 + 8, 3])) == (4, b"DD")
    assert cheapest_edits(bytes([2, 2, 2, 3])) == (1 + 0, b"KRKK")
    n = 20000
    assert cheapest_edits(bytes([2, 3] * n)) == (0, b"KK" * n)


def test_rows_of_a_repaired_conversation(spark):
    rows = [(7, 1, "user", "Hello."), (7, 2, "user", "And?"), (7, 3, "user", "And?"), (7, 4, "tool", "Yes.")]
    docs = spark.createDataFrame([(*x, "own") for x in rows], SCHEMA + ", edit string")
    assert [tuple(x) for x in repair(docs).select("turn", "fault", "edit", "new_role", "text").collect()] == [
        (1, None, "D", None, "Hello."),  # as cheap as to keep it, and less in ASCII
        (2, None, "K", "user", "And?"),
        (3, "duplicate", "D", None, "And?"),
        (4, None, "R", "assistant", "Yes."),
    ]


def test_a_conversation_that_is_lost_whole(spark):
    lost = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert got(spark, [(*lost, "user", "Hi.")]) == [(lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op11_conversation_repair(spark, folder).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
