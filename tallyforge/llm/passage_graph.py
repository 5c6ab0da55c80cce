"""Substring dedup over a De Bruijn graph of words: passages of a document that an earlier one has go.

Every window of SIZE consecutive words is an edge from its first SIZE - 1 words to its last.

1. Each window elects one anchor, the stretch of ANCHOR words in it with the least hash;
   windows in a row that elect the same one are a *piece*.  Occurrences of an edge lie in
   pieces of one anchor, so pieces whose anchor no other has hold no repeated edge and go.
2. Pieces of equal content (128 bits) are one class.  A class that is alone with its anchor
   is a path as it stands: all its edges have the same documents.  The edges of others are
   listed, once a class, and grouped: a repeated one has a source, its occurrence of least
   doc_id.
3. Where a node has one repeated edge in and one out, these are joined; joins of edges to
   such nodes compact a class's edges to paths, and the paths of consecutive pieces of a
   document that keep to their source are strung together to spans.
4. Each span's words are read at the document's and at the source's coordinates and
   compared by SHA-256 (equal texts have been, as wholes); only spans that are equal there
   are removed.

Hot anchors, classes and edges are counted in each task before they are shuffled, and dealt
out where they are joined; no step pairs the members of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, cut, in_small_batches, join_spread, map_rows, release_memory, table
from .rolling import WHITE, blocks, mix, signed, words
from .suffix_dedup import MOST_KEYS, _keys, with_repeated

SIZE = 50
ANCHOR = 20
#: Bytes whose words are hashed at once, and windows that are worked on at once; bound memory alone.
BLOCK_BYTES, BLOCK_WINDOWS = 1_000_000, 200_000
#: Words of a source that are compared together; spans are cut where the source's position is a multiple, so that few differ.
CELL = 64

_PIECE = "anchor long, c1 long, c2 long, doc_id long, k1 long, lo int, n int"
_EDGE = "e1 long, e2 long, u long, v long, c1 long, c2 long, off int, doc_id long, k1 long, at int, most long"
_PATHS = "array<struct<off:int,n:int,s_doc:bigint,s_k1:bigint,s_at:int,joined:boolean>>"
_SPAN = "doc_id long, k1 long, lo int, n int, s_doc long, s_k1 long, s_at int"
_CELL = "doc_id long, k1 long, lo int, s_doc long, s_k1 long, at int, n int, digest binary"
_BASES = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


class WordHash:
    """64-bit hashes of any stretch of words, alike wherever they stand; ``which`` of two that are unrelated but for the words' own."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        up, down = (np.full(len(hashes) + 1, x, "u8") for x in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(len(hashes) + 1, "u8")
        np.cumsum(mix(hashes + np.uint64(which)) * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of one text, BLOCK_BYTES at a time."""
    out, at = [], 0
    while at < len(text):
        end = min(at + BLOCK_BYTES, len(text))
        while end < len(text) and not WHITE[text[end]]:
            end += 1
        out.append(words([text[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, "u8")


def _segments(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first word and number of words of stretches that hold each window once, and the hashes of all their words."""
    for a, b in blocks(texts, BLOCK_BYTES):
        if b - a == 1 and len(texts[a]) > BLOCK_BYTES:
            hashes = word_hashes(texts[a])
            for at in range(0, max(1, len(hashes) - size + 1), BLOCK_WINDOWS):
                part = hashes[at : at + BLOCK_WINDOWS + size - 1]
                yield np.array([a]), np.array([at]), np.array([len(part)]), part
        else:
            hashes, counts = words(texts[a:b])
            yield np.arange(a, b), np.zeros(b - a, "i8"), counts, hashes


def least_places(each: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbours stands; of equal ones, the last."""
    most = np.uint64(0xFFFFFFFF)
    n = len(each)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = (each & ~most) | (most - np.arange(n, dtype="u8"))
    rows = padded.reshape(-1, width)
    tails = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    heads = np.minimum.accumulate(rows, axis=1).ravel()
    return (most - (np.minimum(tails[: n - width + 1], heads[width - 1 : n]) & most)).astype("i8")


def pieces(sizes: np.ndarray, hashes: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segment, first window, windows, hash of the anchor and two of the content of each piece; segments of ``sizes`` words follow each other."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    last = np.repeat(ends, sizes)  # where each word's segment ends
    at = np.arange(len(hashes))
    first = at[at + size <= last]
    if not len(first):
        return (np.zeros(0, "i8"),) * 6
    one, two = WordHash(hashes), WordHash(hashes, 1)
    every = np.arange(len(hashes) - anchor + 1)
    each = one.of(every, every + anchor)
    place = least_places(each, size - anchor + 1)[first]
    of = np.searchsorted(ends, first, side="right")
    breaks = np.flatnonzero((place[1:] != place[:-1]) | (of[1:] != of[:-1])) + 1
    a, b = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(first)]])
    lo, n = first[a], b - a
    stop = lo + n + size - 1
    return of[a], lo - starts[of[a]], n, each[place[a]], one.of(lo, stop), two.of(lo, stop)


def find_pieces(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc_id, k1 = pdf["doc_id"].to_numpy(), pdf["k1"].to_numpy()
            for text, begin, sizes, hashes in _segments(pdf["bytes"].tolist(), size):
                of, lo, n, anchors, c1, c2 = pieces(sizes, hashes, size, anchor)
                row = text[of]
                yield pd.DataFrame({"anchor": signed(anchors), "c1": signed(c1), "c2": signed(c2), "doc_id": doc_id[row], "k1": k1[row], "lo": (lo + begin[of]).astype("i4"), "n": n.astype("i4")})
        release_memory()

    return docs.mapInPandas(run, _PIECE)


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` (doc_id, k1 and more, a row each) with ``bytes`` of the text; of rows repeated whole one is read.

    Up to MOST_KEYS keys (16 bytes each) are told to all tasks, so that only those texts are shuffled.
    """
    if lists.count() <= MOST_KEYS:
        docs = docs.join(F.broadcast(lists.select("doc_id", "k1")), ["doc_id", "k1"], "left_semi")
    return docs.groupBy("doc_id", "k1").agg(F.first("bytes").alias("bytes")).join(lists.hint("merge"), ["doc_id", "k1"])


def list_edges(texts: DataFrame, size: int) -> DataFrame:
    """The edges of classes, from one text of each: (doc_id, k1, bytes, own: lo, n, c1, c2, most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, lists = pdf["bytes"].tolist(), pdf["own"].tolist()
            ids, keys = pdf["doc_id"].to_numpy(), pdf["k1"].to_numpy()
            for x, y in blocks(data, BLOCK_BYTES):
                if y - x == 1:
                    hashes = word_hashes(data[x])
                    counts = np.array([len(hashes)])
                else:
                    hashes, counts = words(data[x:y])
                begins = np.cumsum(counts) - counts
                one, two = WordHash(hashes), WordHash(hashes, 1)
                of = np.repeat(np.arange(x, y), [len(o) for o in lists[x:y]])
                told = np.array([(p["lo"], p["n"], p["c1"], p["c2"], p["most"]) for o in lists[x:y] for p in o], "i8").reshape(-1, 5).T
                for a in range(0, len(of), 4096):  # pieces
                    lo, n, c1, c2, most = told[:, a : a + 4096]
                    piece = np.repeat(np.arange(len(n)), n)
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row = of[a : a + 4096][piece]
                    at = lo[piece] + off
                    k = at + begins[row - x]
                    hashed = {"e1": one.of(k, k + size), "e2": two.of(k, k + size), "u": one.of(k, k + size - 1), "v": one.of(k + 1, k + size)}
                    own = {"c1": c1[piece], "c2": c2[piece], "off": off.astype("i4"), "doc_id": ids[row], "k1": keys[row], "at": at.astype("i4"), "most": most[piece]}
                    yield pd.DataFrame({c: signed(h) for c, h in hashed.items()} | own)
        release_memory()

    return texts.mapInPandas(run, _EDGE)


def repeated_edges(edges: DataFrame) -> DataFrame:
    """e1, e2, their ``source`` (doc_id, k1, at), rows ``n`` and whether they are ``joined`` to the edge before them, of edges that two documents have.

    That is so where their first node has one repeated edge out and not several in (none: the edge before it is of a class alone with its anchor).
    """
    source = F.min(F.struct("doc_id", "k1", "at")).alias("source")
    several = edges.groupBy("e1", "e2").agg(source, F.max("most").alias("most"), F.first("u").alias("u"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    repeated = cut(several.where("source.doc_id < most").drop("most"), "repeated")
    into = repeated.groupBy("v").agg(F.count(F.lit(1)).alias("into"))
    out = repeated.groupBy("u").agg(F.count(F.lit(1)).alias("out"), F.first("e1").alias("e1"), F.first("e2").alias("e2")).where("out = 1")
    joined = out.join(into, F.col("u") == F.col("v"), "left").where("coalesce(into, 1) = 1").select("e1", "e2", F.lit(True).alias("joined"))
    return cut(repeated.join(joined, ["e1", "e2"], "left").select("e1", "e2", "source", "n", F.coalesce("joined", F.lit(False)).alias("joined")), "graph")


def compacted(edges: DataFrame, graph: DataFrame) -> DataFrame:
    """c1, c2 and ``paths`` of each class: nonbranching runs of its repeated edges whose sources follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own in pdf["own"]:
                paths: list[dict] = []
                for off, doc, k1, at, joined in sorted({(x["off"], x["doc_id"], x["k1"], x["at"], x["joined"]) for x in own}):
                    p = paths[-1] if paths else None
                    if p and joined and (p["off"] + p["n"], p["s_doc"], p["s_k1"], p["s_at"] + p["n"]) == (off, doc, k1, at):
                        p["n"] += 1
                    else:
                        paths.append({"off": off, "n": 1, "s_doc": doc, "s_k1": k1, "s_at": at, "joined": joined})
                out.append(paths)
            yield pd.DataFrame({"c1": pdf["c1"], "c2": pdf["c2"], "paths": out})

    met = join_spread(edges.select("e1", "e2", "c1", "c2", "off"), graph, ["e1", "e2"], "n", ["c1", "c2"], edges.count())
    own = F.collect_list(F.struct("off", "source.doc_id", "source.k1", "source.at", "joined")).alias("own")  # as many as a piece has windows
    return met.groupBy("c1", "c2").agg(own).mapInPandas(run, f"c1 long, c2 long, paths {_PATHS}")


def strung_spans(found: DataFrame) -> DataFrame:
    """Spans of windows and their sources, from each text's paths (doc_id, k1, own: lo, n, s_doc, s_k1, s_at, joined)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, k1, own in zip(pdf["doc_id"], pdf["k1"], pdf["own"], strict=True):
                spans: list[list] = []
                for lo, n, *source, s_at, joined in sorted((x["lo"], x["n"], x["s_doc"], x["s_k1"], x["s_at"], x["joined"]) for x in own):
                    p = spans[-1] if spans else None
                    if p and joined and p[0] + p[1] == lo and p[2] == source and p[3] + p[1] == s_at:
                        p[1] += n
                    else:
                        spans.append([lo, n, source, s_at])
                out += [(doc_id, k1, lo, n, *source, s_at) for lo, n, source, s_at in spans]
            yield pd.DataFrame(out, columns=["doc_id", "k1", "lo", "n", "s_doc", "s_k1", "s_at"])

    return found.mapInPandas(run, _SPAN)


class Words:
    """The words of a text by number."""

    def __init__(self, data: bytes):
        flags = WHITE[np.frombuffer(data, "u1")]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], flags, [True]])))
        self.data, self.starts, self.ends = data, edges[::2], edges[1::2]
        gaps = self.ends[:-1]
        other = (self.starts[1:] - gaps != 1) | (np.frombuffer(data, "u1")[gaps] != 32)
        self.others = np.concatenate([[0], np.cumsum(other)])  # gaps that are no single space

    def digest(self, at: int, n: int) -> bytes:
        """SHA-256 of ``n`` words joined by one space."""
        if self.others[at] == self.others[at + n - 1]:
            return hashlib.sha256(self.data[self.starts[at] : self.ends[at + n - 1]]).digest()
        return hashlib.sha256(b" ".join(self.data[self.starts[at] : self.ends[at + n - 1]].split())).digest()


def unequal_spans(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """doc_id, k1 and lo of spans whose words differ at their source's coordinates; none but where 128 bits of hashes collide."""

    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, k1, data, own in zip(pdf["doc_id"], pdf["k1"], pdf["bytes"], pdf["own"], strict=True):
                held, out = Words(data), []
                for x in own:
                    at, end = x["s_at"], x["s_at"] + x["n"] + size - 1
                    while at < end:
                        n = min(end, at - at % CELL + CELL) - at
                        out.append((doc_id, k1, x["lo"], x["s_doc"], x["s_k1"], at, n, held.digest(x["lo"] + at - x["s_at"], n)))
                        at += n
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _CELL.split(", ")])
        release_memory()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, k1, data, own in zip(pdf["doc_id"], pdf["k1"], pdf["bytes"], pdf["own"], strict=True):
                held = Words(data)
                out = [(doc_id, k1, x["at"], x["n"], bytes(x["digest"])) for x in own if held.digest(x["at"], x["n"]) != bytes(x["digest"])]
                yield pd.DataFrame(out, columns=["s_doc", "s_k1", "at", "n", "digest"])
        release_memory()

    parts = spans.where("k1 <> s_k1 OR lo <> s_at")  # else both are at one place of texts with one SHA-256
    own = parts.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("lo", "n", "s_doc", "s_k1", "s_at")).alias("own"))
    cells = cut(_with_texts(docs, cut(own, "own")).mapInPandas(claim, _CELL), "cells")
    # a source's list is as long as its text at most: the cells in it, and their beginnings and ends
    asked = cells.select(F.col("s_doc").alias("doc_id"), F.col("s_k1").alias("k1"), "at", "n", "digest").groupBy("doc_id", "k1").agg(F.collect_set(F.struct("at", "n", "digest")).alias("own"))
    bad = cut(_with_texts(docs, cut(asked, "asked")).mapInPandas(compare, "s_doc long, s_k1 long, at int, n int, digest binary"), "unequal")
    return cells.join(bad, ["s_doc", "s_k1", "at", "n", "digest"], "left_semi").select("doc_id", "k1", "lo").distinct()


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """Spans (_SPAN: windows ``lo`` to ``lo`` + ``n`` - 1 and where their source has them) that start in a document of smaller doc_id too; ``docs`` are doc_id, k1, bytes."""
    docs = docs.where("doc_id IS NOT NULL")
    met = cut(with_repeated(cut(find_pieces(docs, size, anchor), "pieces"), "anchor", ["doc_id", "k1", "lo"]), "met")
    least = F.min(F.struct("doc_id", "k1", "lo")).alias("at")
    classes = cut(met.groupBy("anchor", "c1", "c2").agg(least, F.max("doc_id").alias("most"), F.first("n").alias("n")), "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    judged = cut(join_spread(classes, several, ["anchor"], None, ["c1", "c2"], classes.count()), "judged")
    chosen = judged.where("kinds > 1").groupBy("at.doc_id", "at.k1").agg(F.collect_list(F.struct("at.lo", "n", "c1", "c2", "most")).alias("own"))
    edges = cut(list_edges(_with_texts(docs, cut(chosen, "chosen")), size), "edges")
    alone = judged.where("kinds = 1 AND at.doc_id < most")
    path = F.struct(F.lit(0).alias("off"), "n", F.col("at.doc_id").alias("s_doc"), F.col("at.k1").alias("s_k1"), F.col("at.lo").alias("s_at"), F.lit(True).alias("joined"))
    paths = cut(compacted(edges, repeated_edges(edges)).unionByName(alone.select("c1", "c2", F.array(path).cast(_PATHS).alias("paths"))), "paths")
    found = join_spread(met, paths, ["c1", "c2"], None, ["doc_id", "k1", "lo"], met.count())
    own = found.select("doc_id", "k1", "lo", F.explode("paths").alias("p")).where("p.s_doc < doc_id")
    own = own.groupBy("doc_id", "k1").agg(F.collect_set(F.struct((F.col("lo") + F.col("p.off")).alias("lo"), "p.n", "p.s_doc", "p.s_k1", "p.s_at", "p.joined")).alias("own"))
    spans = cut(strung_spans(own), "spans")
    unequal = cut(unequal_spans(docs, spans, size), "refuted")
    return spans if unequal.isEmpty() else spans.join(unequal, ["doc_id", "k1", "lo"], "left_anti")


def mark_passages(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """``row``, ``bytes`` and ``spans`` (lo, n of windows that an earlier document has; null: none) of each row of ``docs``.

    Words are what lies between ASCII white space.  Null and empty texts and those of fewer
    than ``size`` words have no window.  A null doc_id is neither smaller nor larger than
    another: such rows stay whole and are nobody's source.  Rows of one id are not each
    other's source, whatever their texts; a document that repeats itself keeps all.  An
    empty table gives an empty result; the other columns of ``docs`` are kept, whatever
    their names.
    """
    own = bytes_of(docs["text"])
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _keys(own)[0], own.alias("bytes"))
    spans = repeated_spans(keyed, size, anchor)
    lists = cut(spans.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "lists")
    on = ["doc_id", "k1"]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), own.alias("bytes"), _keys(own)[0], F.monotonically_increasing_id().alias("deal"))
    affected, rest = rows, None
    if lists.count() <= MOST_KEYS:  # then texts without spans aren't shuffled
        told = F.broadcast(lists.select(*on))
        affected, rest = rows.join(told, on, "left_semi"), rows.join(told, on, "left_anti")
    counts = affected.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where("doc_id IS NOT NULL")
    counted = cut(lists.join(counts.hint("merge"), on), "counted")
    total = counted.agg(F.sum("rows")).first()[0] or 0
    out = join_spread(affected, counted, on, "rows", ["deal"], total, "inner" if rest is not None else "left").select("row", "bytes", "spans")
    return out if rest is None else out.unionByName(rest.select("row", "bytes", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))


def kept_words(data: bytes, spans: list | None, size: int) -> Iterator[list[bytes]]:
    """The words of a text that no window of the spans covers, BLOCK_BYTES of text at a time; then an empty list."""
    ranges: list[list[int]] = []
    for lo, n in sorted((x["lo"], x["n"]) for x in ([] if spans is None else spans)):
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], lo + n + size - 1)
        else:
            ranges.append([lo, lo + n + size - 1])
    at = begin = k = 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        own = data[at:end].split()
        kept, i, stop = [], begin, begin + len(own)
        while i < stop:
            while k < len(ranges) and ranges[k][1] <= i:
                k += 1
            a, b = ranges[k] if k < len(ranges) else (stop, stop)
            kept += own[i - begin : max(i, min(a, stop)) - begin]
            i = max(i, min(b, stop)) if a < stop else stop
        yield kept
        at, begin = end, stop


def substring_dedup(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` without the passages of ``size`` words or more that an earlier document has.

    A text that loses words becomes the rest joined by single spaces, others stay as they
    are, null texts too; ``n_chars``, where there is one, follows.  No row goes.  See
    :func:`mark_passages` for the rest.
    """

    @F.pandas_udf("string")
    def rest(data: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else b" ".join(w for part in kept_words(x, s, size) for w in part).decode("utf-8", "replace") for x, s in zip(data, spans, strict=True)], dtype="object")

    marked = mark_passages(docs, size, anchor)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(rest("bytes", "spans"))
    out = marked.select("row", text.alias("new_text"))
    named = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*(named.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def digests(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words left, joined by one space) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data, spans in zip(pdf["bytes"], pdf["spans"], strict=True):
                n, sha = 0, hashlib.sha256()
                for part in kept_words(data, spans, size):
                    if part:
                        sha.update((b" " if n else b"") + b" ".join(part))
                        n += len(part)
                gone = 0 if spans is None else count_words(data) - n
                rows.append((n + gone, gone, sha.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out
        release_memory()

    marked = mark_passages(docs.select("doc_id", "text"), size, anchor).select(F.col("row.doc_id").alias("doc_id"), "bytes", "spans")
    return map_rows(marked, run, "n_words long, n_removed long, kept_sha256 string")


def count_words(data: bytes) -> int:
    flags = WHITE[np.frombuffer(data, "u1")]
    return int((flags[:-1] & ~flags[1:]).sum()) + int(len(flags) > 0 and not flags[0])


@in_small_batches()
def op12_passage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
h AS (SELECT r, doc_id, n, p, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {SIZE - 1} FOLLOWING)) AS h FROM x),
w AS (SELECT r, doc_id, p, h FROM h WHERE p + {SIZE - 1} <= n),
least AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {SIZE})) AS p FROM w JOIN least USING (h) WHERE first < doc_id),
kept AS (
  SELECT x.r, count(g.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS left_over
  FROM x LEFT JOIN gone g ON x.r = g.r AND x.p = g.p GROUP BY x.r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (r)
"""
