"""Suffix-array dedup: bytes of passages that stand anywhere else, from run-length indexes.

A passage of ``length`` bytes is marked if it starts at two places of the corpus.  To find
the few stretches that must be indexed at all, every passage elects one anchor: the short
string in it with the least hash.  Copies elect alike, so a passage is repeated only if its
anchor is; and the passages of a text that elect one anchor (its *run*) follow each other.

1. Runs are counted by anchor and by their whole content.  A run whose whole content
   recurs is repeated as a whole; one whose anchor is unique is not repeated at all.
2. The rest are split by where the anchor stands in the passage, and keyed by the bytes
   that all passages of a part share.  A part whose key is unique holds no repeat.
3. Parts of one key go to one shard.  Each shard builds a run-compressed
   Burrows-Wheeler transform with sampled run ends (:mod:`.runs`), streams the parts'
   matching statistics and marks the passages that match elsewhere.
4. Parts of a key that too many share are split finer, again and again, until each part
   is one passage, where counting decides.  No step pairs the members of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import bytes_of, cut, in_small_batches, join_spread, map_rows, release_memory
from .rolling import WHITE, PrefixHash, mix, signed
from .runs import repeated_windows

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 64
#: Parts of one key that are indexed together; keys with more are split finer.
GROUP = 400
#: Bytes of a shard, about.
SHARD_BYTES = 256_000
#: Shards of one task, about; sorting suffixes takes seconds a megabyte, so tasks are sized by that, not by bytes.
TASK_SHARDS = 8
#: Bytes of text that are searched for anchors at once; bounds memory alone.
BLOCK = 500_000
#: Repeated anchors that are broadcast.
MOST_KEYS = 1_000_000
#: Multipliers that tell equal contents at unequal places apart.
_PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_PART = "part long, k1 long, k2 long, lo int, off int, open boolean, bytes binary"
_SPAN = "k1 long, k2 long, lo int, hi int"


def _keys(data: Column) -> list[Column]:
    """Two longs that name a text: the first 128 bits of its SHA-256."""
    sha = F.sha2(data, 256)
    return [F.conv(F.substring(sha, i, 16), 16, -10).cast("long").alias(k) for i, k in ((1, "k1"), (17, "k2"))]


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of stretches that hold each passage once, about BLOCK bytes at a time."""
    out, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, BLOCK):
            out.append((i, a, text[a : a + BLOCK + length - 1]))
            size += len(out[-1][2])
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


def anchored_runs(segments: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of passages by elected anchor: segment, first passage, passages, anchor's place after the first, hash of the anchor and two of the content."""
    data = np.frombuffer(b"".join(segments), "u1")
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashes = PrefixHash(data)
    each = hashes.each(anchor)
    n, width = len(each), length - anchor + 1
    most = np.uint64(0xFFFFFFFF)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = (each & ~most) | (most - np.arange(n, dtype="u8"))  # of equal ones the last is elected
    rows = padded.reshape(-1, width)
    least = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1]
    np.minimum.accumulate(rows, axis=1, out=rows)
    least = np.minimum(least, padded[width - 1 : n])
    del padded, rows
    fits = np.zeros(len(data) + 1, "i4")
    np.add.at(fits, starts, 1)
    np.add.at(fits, ends - length + 1, -1)
    first = np.flatnonzero(np.cumsum(fits)[: n - width + 1] > 0)
    place = (most - (least[first] & most)).astype("i8")
    del least, fits
    new_text = np.zeros(len(data) + 1, bool)
    new_text[starts] = True
    breaks = np.flatnonzero((place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | new_text[first[1:]]) + 1
    a, b = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(first)]])
    lo, count, place = first[a], b - a, place[a]
    of = np.searchsorted(ends, lo, side="right")
    stop, off = lo + count + length - 1, (place - lo).astype("u8")
    anchors, content = each[place], mix(hashes.of(lo, stop) ^ off * _PLACE[0])
    del hashes, each
    again = mix(PrefixHash(data, 1).of(lo, stop) ^ off * _PLACE[1])
    return of, lo - starts[of], count, place - lo, anchors, content, again


def find_runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor, content, content2, k1, k2, lo, n, off of each run of the texts (k1, k2, bytes); equal contents are told by 128 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            for segments in _segments(pdf["bytes"].tolist(), length):
                of, lo, n, off, anchors, content, again = anchored_runs([x for _, _, x in segments], length, anchor)
                row = np.array([i for i, _, _ in segments])[of]
                start = np.array([a for _, a, _ in segments])[of]
                yield pd.DataFrame({"anchor": signed(anchors), "content": signed(content), "content2": signed(again), "k1": k1[row], "k2": k2[row], "lo": lo + start, "n": n, "off": off})
        release_memory()

    return docs.mapInPandas(run, "anchor long, content long, content2 long, k1 long, k2 long, lo int, n int, off int")


def split_parts(parts: Iterator[tuple], cell: int, length: int, anchor: int) -> Iterator[dict]:
    """Parts (k1, k2, lo, off, open, bytes), split by the anchor's place in steps of ``cell``.

    A step's key hashes what all its passages share: from the anchor's last place in a
    passage back to its first.
    """
    for k1, k2, lo, off, open_, data in parts:
        hashes = PrefixHash(np.frombuffer(data, "u1"))
        n = len(data) - length + 1
        for step in range((off - n + 1) // cell, off // cell + 1):
            near, far = step * cell, min(step * cell + cell - 1, length - anchor)
            a, b = max(0, off - far), min(n - 1, off - near)
            shared = hashes.of(np.array([off - near]), np.array([off - far + length]))
            key = mix(shared + np.uint64((step + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            yield {"part": signed(key)[0], "k1": k1, "k2": k2, "lo": lo + a, "off": off - a, "open": open_, "bytes": data[a : b + length]}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "k1", "k2", "lo", "off", "open", "bytes"])


def _in_frames(parts: Iterator[dict], most: int = 5000) -> Iterator[pd.DataFrame]:
    rows: list[dict] = []
    for part in parts:
        rows.append(part)
        if len(rows) >= most:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def _ranges(marked: np.ndarray) -> np.ndarray:
    """First and last index of each stretch that is true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype("i1")))
    return edges.reshape(-1, 2) - [0, 1]


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """Spans (k1, k2, lo, hi: first and last passage) of the open parts that repeat, by shard."""
    size = parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for marked, x in zip(repeated_windows(pdf["bytes"].tolist(), length), pdf.itertuples(), strict=True):
            if x.open:
                rows += [(x.k1, x.k2, x.lo + a, x.lo + b) for a, b in _ranges(marked)]
        release_memory()
        return pd.DataFrame(rows, columns=["k1", "k2", "lo", "hi"])

    shards = max(1, size // SHARD_BYTES)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards))).repartition(max(1, shards // TASK_SHARDS), "shard")
    return dealt.groupBy("shard").applyInPandas(mark, _SPAN)


def text_counts(docs: DataFrame) -> DataFrame:
    """k1, k2, ``rows`` and ``row`` (one of them) of each text (k1, k2, row)."""
    return cut(docs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("row")), "texts")


def with_repeated(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows whose ``key`` another row has too.

    Up to MOST_KEYS such keys (8 bytes each) are sent to the rows; of more the rows are
    shuffled by key, and those of a hot key dealt out by ``by``.
    """
    shared = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key")).where("rows_of_key > 1"), "shared")
    if shared.count() <= MOST_KEYS:
        return rows.join(F.broadcast(shared.select(key)), key)
    return join_spread(rows, shared, [key], "rows_of_key", by, rows.count())


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, texts: DataFrame | None = None) -> DataFrame:
    """k1, k2, lo, hi: first and last of passages that also start elsewhere, in each text (k1, k2, row, bytes); ``texts`` is from :func:`text_counts`."""
    texts = text_counts(docs) if texts is None else texts
    same = ["anchor", "content", "content2"]
    runs = cut(find_runs(docs, length, anchor), "runs")
    met = cut(with_repeated(runs, "anchor", ["k1", "k2", "lo"]), "met")  # of runs by themselves no more is asked
    classes = cut(met.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("k1", "k2", "lo", "n", "off"))), "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = classes.where("copies > 1").select(*same, "copies")
    found = join_spread(met, whole, same, "copies", ["k1", "k2", "lo"], met.count())
    spans = [cut(found.select("k1", "k2", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")), "whole")]
    open_ = join_spread(classes, several, ["anchor"], "kinds", ["k1", "k2", "lo"], classes.count())
    chosen = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "off", (F.col("copies") == 1).alias("open"))).alias("runs"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            parts = []
            for x in pdf.itertuples():
                if (x.k1, x.k2) != before:  # of rows that are repeated whole, which follow each other, one is enough
                    parts += [(x.k1, x.k2, r["lo"], r["off"], r["open"], x.bytes[r["lo"] : r["lo"] + r["n"] + length - 1]) for r in x.runs]
                before = (x.k1, x.k2)
            yield from _in_frames(split_parts(iter(parts), cell, length, anchor))
        release_memory()

    cell = -(-(length - anchor + 1) // 2)
    chosen = chosen.join(texts.select("k1", "k2", "row").hint("merge"), ["k1", "k2"])
    holding = docs.join(chosen.hint("merge"), ["k1", "k2", "row"])  # one row of each text, wherever its copies are
    parts = cut(holding.select("k1", "k2", "bytes", "runs").mapInPandas(read, _PART), "parts")
    while True:
        counts = cut(parts.groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.max("open").alias("any")).where("members > 1 AND any").select("part", F.col("members").alias("n"), "members"), "counts")
        shared = join_spread(parts, counts, ["part"], "n", ["k1", "k2", "lo"], parts.count())
        if cell == 1:  # a part is one passage, so its bytes decide
            passages = cut(shared.where("members > 1").select(F.sha2("bytes", 256).alias("sha"), "k1", "k2", "lo", "open"), "passages")
            again = passages.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            spans.append(join_spread(passages.where("open"), again, ["sha"], "n", ["k1", "k2", "lo"], passages.count()).select("k1", "k2", "lo", F.col("lo").alias("hi")))
            break
        spans.append(cut(_indexed(cut(shared.where(F.col("members") <= group).drop("members"), "shards"), length), "spans"))
        if counts.where(F.col("members") > group).isEmpty():
            break
        finer = -(-cell // 4)

        def split(batches: Iterator[pd.DataFrame], to: int = finer) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield from _in_frames(split_parts(pdf[["k1", "k2", "lo", "off", "open", "bytes"]].itertuples(index=False), to, length, anchor))
            release_memory()

        cell = finer
        parts = cut(shared.where(F.col("members") > group).drop("members").mapInPandas(split, _PART), "finer")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def whole_word_spans(docs: DataFrame, texts: DataFrame, spans: DataFrame, length: int, size: int) -> DataFrame:
    """Spans (k1, k2, lo, hi) of those windows of ``size`` words inside the stretches of ``spans`` that stand elsewhere, each as one whole.

    A stretch may be made of short repeats side by side; a window of words only counts if
    another place has all of it.  As any such window lies in a stretch at both its places, it
    is enough to count those there, 128 bits each; a text's rows are places of their own.
    """
    by_text = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    chosen = cut(by_text.join(texts.hint("merge"), ["k1", "k2"]), "stretches")
    if chosen.count() <= MOST_KEYS:  # then other texts aren't shuffled
        docs = docs.join(F.broadcast(chosen.select("k1", "k2")), ["k1", "k2"], "left_semi")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            for k1, k2, data, own, rows in zip(pdf["k1"], pdf["k2"], pdf["bytes"], pdf["spans"], pdf["rows"], strict=True):
                if (k1, k2) == before:  # a row that is repeated whole
                    continue
                before = k1, k2
                for a, b in removed_stretches(own, length):
                    flags = np.concatenate([[True], WHITE[np.frombuffer(data[a:b], "u1")], [True]])
                    edges = np.flatnonzero(flags[1:] != flags[:-1])
                    starts, ends = edges[::2], edges[1::2]
                    # of a word that the stretch cuts, only the part inside counts for nothing
                    if a and not WHITE[data[a - 1]] and len(starts) and starts[0] == 0:
                        starts, ends = starts[1:], ends[1:]
                    if b < len(data) and not WHITE[data[b]] and len(ends) and ends[-1] == b - a:
                        starts, ends = starts[:-1], ends[:-1]
                    n = len(starts) - size + 1
                    if n <= 0:
                        continue
                    part = np.frombuffer(data[a:b], "u1")
                    first, last = starts[:n], ends[size - 1 :]
                    yield pd.DataFrame({"h1": signed(PrefixHash(part).of(first, last)), "h2": signed(PrefixHash(part, 1).of(first, last)), "k1": k1, "k2": k2, "a": (first + a).astype("i4"), "b": (last + a).astype("i4"), "rows": rows})
        release_memory()

    held = docs.join(chosen.hint("merge"), ["k1", "k2", "row"]).select("k1", "k2", "bytes", "spans", "rows")
    found = cut(held.mapInPandas(windows, "h1 long, h2 long, k1 long, k2 long, a int, b int, rows long"), "windows")
    again = cut(found.groupBy("h1", "h2").agg(F.sum("rows").alias("places"), F.count(F.lit(1)).alias("n")).where("places > 1").select("h1", "h2", "n"), "places")
    kept = join_spread(found.drop("rows"), again, ["h1", "h2"], "n", ["k1", "k2", "a"], found.count())
    return kept.select("k1", "k2", F.col("a").alias("lo"), (F.col("b") - length).alias("hi"))


def removed_stretches(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte stretches [a, b) that the passages of (lo, hi) spans cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((int(x["lo"]), int(x["hi"])) for x in spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi + length)
        else:
            out.append((lo, hi + length))
    return out


def _without(data: bytes, stretches: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in stretches:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def mark_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, least_words: int = 0) -> DataFrame:
    """``docs`` with ``bytes`` (UTF-8 of the text) and ``spans``, the (lo, hi) passages that stand elsewhere (null: none).

    With ``least_words`` the spans are those of windows of so many whole words, each of which
    stands elsewhere as a whole; such a window must have ``length`` bytes at least.

    Null and empty texts and those shorter than ``length`` hold no passage.  Rows that
    repeat a whole text repeat its passages.  Ids are not used but to deal a text's copies
    out, so they may be null or repeat; the other columns of ``docs`` are kept, whatever
    their names.  An empty table gives an empty result.
    """
    own = bytes_of(docs["text"])
    row = F.xxhash64(*(docs[c] for c in docs.columns if c != "text" and not isinstance(docs.schema[c].dataType, MapType)), F.lit(0)).alias("row")
    keyed = docs.select(*_keys(own), own.alias("bytes"), row)
    texts = text_counts(keyed)
    found = repeated_spans(keyed, length, anchor, group, texts)
    if least_words:
        found = whole_word_spans(keyed, texts, cut(found, "found"), length, least_words)
    by_text = found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    marked = cut(texts.select("k1", "k2", "rows").join(by_text.hint("merge"), ["k1", "k2"], "left"), "marked")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own.alias("bytes"), *_keys(own), row.alias("deal"))
    total = marked.agg(F.sum("rows")).first()[0] or 0
    return join_spread(rows, marked, ["k1", "k2"], "rows", ["deal"], total).select("row", "bytes", "spans")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, least_words: int = 0) -> DataFrame:
    """``docs`` without the bytes that repeated passages cover; a character that loses a byte goes.

    With ``least_words`` only windows of so many words that another place has whole go.

    ``text`` changes and, where there is one, ``n_chars``; all rows and other columns stay.
    A text left empty is the empty text, and a null text stays null.  See
    :func:`mark_repeats` for the rest.
    """
    marked = mark_repeats(docs, length, anchor, group, least_words)

    @F.pandas_udf("string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, spans in batches:
            yield pd.Series([x.decode("utf-8", "ignore") if s is None else _without(x, removed_stretches(s, length)).decode("utf-8", "ignore") for x, s in zip(data, spans, strict=True)], dtype="object")
        release_memory()

    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(kept("bytes", "spans"))
    out = marked.select("row", text.alias("new_text"))
    named = {"text": F.col("new_text"), "n_chars": F.when(F.col("new_text").isNotNull(), F.length("new_text")).cast("long")}
    return out.select(*(named.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data, spans in zip(pdf["bytes"], pdf["spans"], strict=True):
                gone = [] if spans is None else removed_stretches(spans, length)
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_without(data, gone)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    marked = mark_repeats(docs.select("doc_id", "text"), length, anchor, group).select(F.col("row.doc_id").alias("doc_id"), "bytes", "spans")
    return map_rows(marked, run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@in_small_batches()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
