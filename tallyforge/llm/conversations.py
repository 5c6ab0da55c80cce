"""Repair of damaged conversations by cheapest edits: Dial's shortest paths over small integer costs.

A conversation's rows and the states of the pattern ``(s?(ua)+)?`` of role initials span a
graph: keeping, re-roling or deleting a row leads one row on, inserting a turn stays.
Dial's bucket queue records every node's distance to the end; the audit walks tight arcs
from the start, always by the least letter.

Rows are shuffled by conversation once.  Each conversation then streams through its task
twice in sorted order, first as rows without text, whose codes (a byte a row) are the graph,
then with text, which is edited as it passes; Spark spills both sorts.  A hash of a whole
conversation needs its rows in order, so one conversation, however large, is one task, that
holds about a hundred bytes a row at most and never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Costs of edits, and what an undeleted truncated row adds.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ["", "blank", "duplicate", "truncated"]
#: States of the pattern: nothing yet, after s, after u, after a.  The only turn that may be added in each, and where it leads.
ADDED = ("user", "user", "assistant", "user")
LEADS = (2, 2, 3, 2)
ENDS = (0, 3)
#: Where a kept row of initial other, s, u, a leads from each state (-1: nowhere).
KEPT = ((-1, -1, -1, -1), (1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
LEGAL = {"su", "ua", "au"}
_FAR = 2**31 - 1
#: Rows of output that are handed on together; bounds memory alone.
ROWS, CHARACTERS = 2000, 4_000_000

_ROWS = "turn long, role string, text string, fault string, edit string, new_role string"


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn``: conv_id, turn, role, text and ``present``.

    Nulls count as one space, in role and text as in what is hashed; ``turn`` itself stays
    null.  Rows that are dropped stay with ``present`` false, so that their conversation is
    not forgotten.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return (
        conversations.select("conv_id", "turn", "role", "text", fate.alias("fate"))
        .withColumns({"text": text, "role": F.when(F.col("fate") == 4, "user").otherwise(told("role")), "present": F.col("fate") != 0})
        .withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text", "present")
    )


def _fault(text: Column, copy: Column) -> Column:
    """Which of FAULTS a row has first, as a number."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 1).when(copy > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def distances(codes: bytes) -> array:
    """Cost from each node (4 x row + state) to the end, at least of those no farther than the start, by Dial's bucket queue.

    A row's code is its initial (0 other, 1 s, 2 u, 3 a), plus 4 if it must go, plus 8 if it is truncated.
    """
    n = len(codes)
    far = array("i", [_FAR]) * (4 * n + 4)
    size = RE_ROLE + TRUNCATED + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    for state in ENDS:
        far[4 * n + state] = 0
        buckets[0].append(4 * n + state)
    into = [[q for q in range(4) if LEADS[q] == state] for state in range(4)]
    kept = [[[q for q in range(4) if KEPT[c][q] == state] for state in range(4)] for c in range(4)]
    now, empty = 0, 0
    while empty < size and now <= far[0]:
        bucket = buckets[now % size]
        empty = 0 if bucket else empty + 1
        while bucket:
            node = bucket.pop()
            if far[node] != now:
                continue  # reached more cheaply before
            state, base = node & 3, node & ~3
            arcs = [(base + q, INSERT) for q in into[state]]
            if base:
                code = codes[(base >> 2) - 1]
                arcs.append((node - 4, DELETE))
                if not code & 4:
                    more = TRUNCATED if code & 8 else 0
                    arcs += [(base - 4 + q, RE_ROLE + more) for q in into[state]]
                    arcs += [(base - 4 + q, more) for q in kept[code & 3][state]]
            for before, cost in arcs:
                if now + cost < far[before]:
                    far[before] = now + cost
                    buckets[(now + cost) % size].append(before)
        now += 1
    return far


def cheapest_edits(codes: bytes) -> tuple[int, bytes]:
    """Cost, and the initials of the cheapest edits (Delete, Insert, Keep, Rerole), of equally cheap ones the ASCII-least."""
    far = distances(codes)
    n, node, out = len(codes), 0, bytearray()
    while not (node >> 2 == n and node & 3 in ENDS):
        state, base, left = node & 3, node & ~3, far[node]
        code = codes[base >> 2] if base >> 2 < n else None
        more = TRUNCATED if code is not None and code & 8 else 0
        if code is not None and far[node + 4] == left - DELETE:
            out += b"D"
            node += 4
        elif far[base + LEADS[state]] == left - INSERT:
            out += b"I"
            node = base + LEADS[state]
        elif code is not None and not code & 4 and KEPT[code & 3][state] >= 0 and far[base + 4 + KEPT[code & 3][state]] == left - more:
            out += b"K"
            node = base + 4 + KEPT[code & 3][state]
        else:
            out += b"R"
            node = base + 4 + LEADS[state]
    return far[0], bytes(out)


class _Edited:
    """The rows of one conversation, edited as they pass."""

    def __init__(self, codes: bytes):
        self.codes, self.edits, self.at, self.row, self.state = codes, cheapest_edits(codes)[1], 0, 0, 0

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == ord("I"):
            yield None, None, "", None, "I", ADDED[self.state]
            self.at, self.state = self.at + 1, LEADS[self.state]

    def next(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        yield from self.inserted()
        edit, code = chr(self.edits[self.at]), self.codes[self.row]
        new = {"D": None, "K": role, "R": ADDED[self.state]}[edit]
        yield turn, role, text, FAULTS[fault] or None, edit, new
        self.state = {"D": self.state, "K": KEPT[code & 3][self.state], "R": LEADS[self.state]}[edit]
        self.at, self.row = self.at + 1, self.row + 1


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that turn each conversation of ``rows`` (conv_id, turn, role, text) into ``(s?(ua)+)?``.

    Gives, conversation by conversation in order, a row for each edit: turn, role and text
    as they were (null, null and empty for an inserted turn), ``fault`` (blank, duplicate,
    truncated or null), ``edit`` (D, I, K or R) and ``new_role`` (null if deleted).  A row
    whose column ``present`` is false is no turn; a conversation of such rows alone gives one
    row without edit.

    Order is by turn, nulls first, then by role and text.  Null roles and texts count as one
    space; a null ``conv_id`` is a conversation; an empty role has no initial, so it can't be
    kept.  A row is blank without a character other than white space, else a duplicate if the
    conversation has the same role and text before it, else truncated if it doesn't end in
    ``.``, ``!`` or ``?``.  Rows repeated whole are duplicates; extra columns are ignored; an
    empty table gives an empty result.
    """
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), present.alias("present")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("present"), _fault(F.col("text"), F.row_number().over(same))).otherwise(-1)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    judged = own.withColumn("fault", fault).withColumn("code", (initial + F.when(F.col("fault").isin(1, 2), 4).otherwise(0) + F.when(F.col("fault") == 3, 8).otherwise(0)).cast("int"))
    # once without text, for the graph, then with text; both are in the same partition already
    passes = F.explode(F.when(F.col("present"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pass")
    ordered = judged.select("conv_id", "turn", "role", "text", "fault", "code", passes)
    ordered = ordered.sortWithinPartitions("conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "text")
    told = ordered.select("conv_id", "turn", "role", F.when(F.col("pass") == 1, F.col("text")).alias("text"), "fault", "code", "pass")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "text", "fault", "edit", "new_role"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        current, codes, edited = None, bytearray(), None

        def ended() -> list[tuple]:
            return [] if current is None else [(*current, *x) for x in edited.inserted()] if edited else [(*current, None, None, None, None, None, None)]

        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("conv_id", "turn", "role", "text", "fault", "code", "pass")]
            for conv, turn, role, text, fault, code, which in zip(*columns, strict=True):
                if current != (conv,):
                    out += ended()
                    current, codes, edited = (conv,), bytearray(), None
                if which == 0:
                    if fault >= 0:
                        codes.append(code)
                    continue
                edited = edited or _Edited(bytes(codes))
                out += [(conv, *x) for x in edited.next(turn, role, text, fault)]
                size += len(text)
                if len(out) >= ROWS or size >= CHARACTERS:
                    yield pd.DataFrame(out, columns=names, dtype="object")
                    out, size = [], 0
        yield pd.DataFrame(out + ended(), columns=names, dtype="object")

    # ids and turns go as text: pandas has no null among whole numbers
    done = told.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")}).mapInPandas(run, "conv_id string, " + _ROWS.replace("turn long", "turn string"))
    return done.withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation of :func:`repair`'s rows, which must be in its order: counts, cost, audit and hash of what is left."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, current, one = [], None, None
        for pdf in batches:
            for conv, *row in zip(*(pdf[c].tolist() for c in ("conv_id", "turn", "role", "text", "fault", "edit", "new_role")), strict=True):
                if current != (conv,):
                    if one:
                        out.append((*current, *one.row()))
                    current, one = (conv,), _Report()
                one.add(*row)
            yield pd.DataFrame(out, columns=names)
            out = []
        if one:
            yield pd.DataFrame([(*current, *one.row())], columns=names)

    told = edits.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})
    done = told.mapInPandas(run, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


class _Report:
    """What is told of one conversation, added up row by row."""

    def __init__(self):
        self.first = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS[1:], 0)
        self.before, self.audit, self.hash, self.any = None, [], hashlib.sha256(), False

    def add(self, turn: str | None, role: str, text: str, fault: str | None, edit: str | None, new_role: str | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {"I": INSERT, "D": DELETE, "R": RE_ROLE, "K": 0}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self.hash.update(f"{chr(10) if self.any else ''}{new_role}:{text}".encode())
            self.any = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and int(turn) != self.last:
            self.turns, self.last = self.turns + 1, int(turn)
            self.first = self.last if self.first is None else self.first
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repair(damage(table(spark, sf_dir, "conversations"))))
