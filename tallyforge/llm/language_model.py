"""LM scoring with a log-frequency Bloom filter.

The filter holds quantised counts of runs of two and three words: a gram of count c is
entered once for each level up to 1 + floor(log_BASE c), and its count is read back by
probing level after level until one is missing.  Words by themselves have exact counts
beside it, which the base score asks for, and which are quantised in the same way.  Grams are dealt to regions by
their hash; each region is counted and filled in one task and as large as its entries ask
for, so that false positives don't grow with the input.  A small model is broadcast, a few
megabytes at a time; of a larger one each region stays a row of a table, and the distinct
grams of packs of texts are sent to shards of neighbouring regions and their levels back
(:func:`_with_answers`).

The probability of a word leans on what was seen after the same history:
p(w | h) = (c(h w) + STRENGTH p(w | shorter h)) / (c(h) + STRENGTH), from two words of
history down to the add-one frequency of the word.  A history never seen leaves all weight
to the shorter one, and a frequent one takes nearly all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, crc_mod, cut, in_small_batches, map_rows, release_memory
from .rolling import blocks, mix, words

#: Quotient of the counts of neighbouring levels.
BASE = 2.0
#: Occurrences that the shorter history's probability counts as.
STRENGTH = 10.0
BITS_PER_ENTRY = 6
PROBES = 4
#: Bits of the filter that hold all of a gram's probes, and so lie side by side in memory.
LINE = 512
#: Bytes of training text for each region, and the least number of regions; a power of 2 is taken.
REGION_BYTES = 4_000_000
LEAST_REGIONS = 64
#: Bytes of filter and word counts that are broadcast at most; larger models are asked shard by shard.
MOST_BYTES = 192_000_000
#: About the bytes of one broadcast.
PART_BYTES = 8_000_000
#: About the bytes of the neighbouring regions that are asked together.
SHARD_BYTES = 2_000_000
#: Grams that are looked up at once in a shard; bounds memory alone.
LOOKUP = 300_000
#: Bytes of texts whose grams are counted, scored, or looked up together; bound memory alone.
COUNT_BLOCK, SCORE_BLOCK, PACK_BYTES = 3_000_000, 250_000, 2_000_000
#: Counts of words from here on are kept apart; smaller ones take a byte.
LARGE = 255
#: No count of 64 bits has a higher level.
TOP_LEVEL = 64

#: A text's end is a token, its start only comes before others; no word hashes to them but by chance.
END, START = np.uint64(0), np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, each text with its end, and the number of tokens of each."""
    word, counts = words([x.lower() for x in texts])
    return np.insert(word, np.cumsum(counts), END), counts + 1


@dataclass
class Runs:
    """Grams that end at each token: of two words, and of three where the text has as many (``long``), its start included."""

    pair: np.ndarray
    triple: np.ndarray
    long: np.ndarray


def runs(token: np.ndarray, counts: np.ndarray) -> Runs:
    first = np.cumsum(counts) - counts
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = START
    pair = mix(before * _STEP + token)
    history = np.zeros_like(pair)
    history[1:] = pair[:-1]
    long = np.ones(len(token), bool)
    long[first] = False
    return Runs(pair, mix(history * _STEP + token), long)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE c) of counts of at least 1."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype("i8")


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 of level 0."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


def most_count(level: np.ndarray) -> np.ndarray:
    """The greatest count of each level."""
    return np.where(level > 0, np.ceil(BASE**level.astype("f8") - 1e-9) - 1, 0.0)


@dataclass(frozen=True)
class Regions:
    """How hashes are dealt to 2 ** ``bits`` regions.  48 bits beyond those tell a region's grams apart."""

    bits: int

    @property
    def dropped(self) -> np.uint64:
        return np.uint64(max(0, 16 - self.bits))

    def of(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).astype("i8")

    def narrow(self, grams: np.ndarray) -> np.ndarray:
        return grams >> self.dropped << self.dropped

    def split(self, sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The regions that occur and where each begins and ends."""
        region, start = np.unique(self.of(sorted_grams), return_index=True)
        return region, np.append(start, len(sorted_grams))

    def packed(self, grams: np.ndarray) -> bytes:
        """Narrowed grams without their regions, six bytes each."""
        return np.ascontiguousarray((grams >> self.dropped).astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()

    def unpacked(self, data: bytes, region: np.ndarray | int) -> np.ndarray:
        """Packed grams of one region, or each of its own."""
        out = np.zeros((len(data) // 6, 8), "u1")
        out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
        within = (1 << 64 - self.bits) - 1
        return ((out.view("<u8").ravel() << self.dropped) & np.uint64(within)) | np.asarray(region, "u8") << np.uint64(64 - self.bits)


def regions_for(n_bytes: int) -> Regions:
    """Regions of about REGION_BYTES of text each."""
    return Regions((max(LEAST_REGIONS, -(-n_bytes // REGION_BYTES)) - 1).bit_length())


def _lines(grams: np.ndarray, lines: np.ndarray | int) -> np.ndarray:
    """The line of each gram among its region's."""
    return (mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.asarray(lines, "u8") >> np.uint64(32)


def _probes(grams: np.ndarray, level: int) -> np.ndarray:
    """The bits within its line that a gram at a level has, a row for each probe."""
    h = mix(grams + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.stack([(h >> np.uint64(9 * i)) & np.uint64(LINE - 1) for i in range(PROBES)])


def fill(grams: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter of one region's grams as bytes."""
    level = levels_of(counts) if len(counts) else np.zeros(0, "i8")
    lines = max(1, -(-int(level.sum()) * bits_per_entry // LINE))
    bits = np.zeros(lines * LINE, bool)
    first = _lines(grams, lines) * np.uint64(LINE)
    for k in range(1, int(level.max(initial=0)) + 1):
        own = level >= k
        for probe in _probes(grams[own], k):
            bits[first[own] + probe] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Part:
    """Some neighbouring regions of the model: filters, words and their exact counts."""

    first: int
    lines: np.ndarray
    data: np.ndarray
    word: np.ndarray
    count: np.ndarray
    large: dict[int, int]

    def levels(self, grams: np.ndarray, regions: Regions) -> np.ndarray:
        """Highest level of each gram of these regions before the first that is missing; 0 for unseen ones."""
        of = regions.of(grams) - self.first
        starts = np.cumsum(self.lines) - self.lines
        at = (starts[of] + _lines(grams, self.lines[of]).astype("i8")) * (LINE // 8)
        out, todo = np.zeros(len(grams), "u1"), np.arange(len(grams))
        for level in range(1, TOP_LEVEL + 1):
            probe = _probes(grams[todo], level)
            byte = self.data[at[todo] + (probe >> np.uint64(3)).astype("i8")]
            todo = todo[((byte >> (probe & np.uint64(7)).astype("u1")) & 1).all(axis=0)]
            if not len(todo):
                break
            out[todo] = level
        return out

    def counts(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(word), "i8")
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        out = np.where(self.word[at] == word, self.count[at], 0).astype("i8")
        for i in np.flatnonzero(out == LARGE):
            out[i] = self.large[int(at[i])]
        return out


def part_of(rows: list, first: int, last: int) -> Part:
    """Regions ``first`` to ``last`` from their rows (region, bits, words, counts); those without a row are empty."""
    filters = {r["region"]: np.frombuffer(r["bits"], "u1") for r in rows}
    own = [filters.get(i, np.zeros(LINE // 8, "u1")) for i in range(first, last + 1)]
    word = np.concatenate([np.zeros(0, "u8"), *(np.frombuffer(r["words"], "u8") for r in rows)])
    count = np.concatenate([np.zeros(0, "i8"), *(np.frombuffer(r["counts"], "i8") for r in rows)])
    large = {int(i): int(count[i]) for i in np.flatnonzero(count >= LARGE)}
    return Part(first, np.array([len(x) * 8 // LINE for x in own]), np.concatenate(own), word, np.minimum(count, LARGE).astype("u1"), large)


class WholeModel:
    """All parts at hand; looks grams and words up in sorted order, a part at a time."""

    def __init__(self, parts: list[Part], regions: Regions):
        self.parts, self.regions = parts, regions

    def _each(self, keys: np.ndarray, ask, dtype: str) -> np.ndarray:
        kinds, of = np.unique(keys, return_inverse=True)
        out, region = np.zeros(len(kinds), dtype), self.regions.of(kinds)
        for part in self.parts:
            a, b = np.searchsorted(region, [part.first, part.first + len(part.lines)])
            if a < b:
                out[a:b] = ask(part, kinds[a:b])
        return out[of]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return self._each(self.regions.narrow(grams), lambda part, x: part.levels(x, self.regions), "u1")

    def counts(self, word: np.ndarray) -> np.ndarray:
        return self._each(word, Part.counts, "i8")


class Answers:
    """Levels and counts that were looked up before, of sorted grams and words."""

    def __init__(self, grams: np.ndarray, level: np.ndarray, word: np.ndarray, count: np.ndarray, regions: Regions):
        self.grams, self.level, self.word, self.count, self.regions = grams, level, word, count, regions

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return self.level[np.searchsorted(self.grams, self.regions.narrow(grams))]

    def counts(self, word: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.word, word)]


@dataclass
class LanguageModel:
    """The regions' table (region, bits, words, counts), totals, and the parts if they are broadcast."""

    table: DataFrame
    regions: Regions
    n_tokens: int
    n_words: int
    n_bytes: int
    parts: list | None = None

    def at_hand(self) -> WholeModel:
        return WholeModel([x.value for x in self.parts], self.regions)


def count_regions(texts: DataFrame, regions: Regions, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """The table of :class:`LanguageModel` over all ``bytes``, with ``tokens`` and ``kinds`` of words.

    A task sends each region one row for each block of texts, in which a gram comes once;
    nothing but a gram's own blocks makes its region larger.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["bytes"].tolist()
            for a, b in blocks(data, COUNT_BLOCK):
                token, counts = tokens(data[a:b])
                own = runs(token, counts)
                grams = regions.narrow(np.concatenate([own.pair, own.triple[own.long], np.full(len(counts), START)]))
                del own
                gram, n = np.unique(grams, return_counts=True)
                word, times = np.unique(token, return_counts=True)
                del grams, token
                # all rows are cut from the block's own bytes, as there are as many as blocks times regions
                region, at = regions.split(gram)
                packed, (often, of) = regions.packed(gram), _often(n, at)
                rows = {r: [b"", b"", packed[6 * i : 6 * j], often[8 * k : 8 * m]] for r, i, j, k, m in zip(region.tolist(), *_ends(at), *_ends(of), strict=True)}
                region, at = regions.split(word)
                data_, n_ = word.tobytes(), times.astype("u4").tobytes()
                for r, i, j in zip(region.tolist(), *_ends(at), strict=True):
                    rows.setdefault(r, [b"", b"", b"", b""])[:2] = data_[8 * i : 8 * j], n_[4 * i : 4 * j]
                yield pd.DataFrame([(r, *x) for r, x in rows.items()], columns=["region", "words", "times", "grams", "often"])
        release_memory()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        region = int(pdf["region"].iloc[0])
        word, times = _summed(np.frombuffer(b"".join(pdf["words"]), "u8"), np.frombuffer(b"".join(pdf["times"]), "u4"))
        n = _counts(pdf["often"].tolist(), [len(g) // 6 for g in pdf["grams"]])
        gram, n = _summed(regions.unpacked(b"".join(pdf["grams"]), region), n)
        out = (region, fill(gram, n, bits_per_entry).tobytes(), word.tobytes(), times.tobytes(), int(times.sum()), len(word))
        return pd.DataFrame([out], columns=["region", "bits", "words", "counts", "tokens", "kinds"])

    sent = texts.select("bytes").mapInPandas(run, "region int, words binary, times binary, grams binary, often binary")
    return cut(sent.groupBy("region").applyInPandas(unite, "region int, bits binary, words binary, counts binary, tokens long, kinds long"), "model")


def _ends(at: np.ndarray) -> tuple[list[int], list[int]]:
    at = at.tolist()
    return at[:-1], at[1:]


def _often(n: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The counts that are not 1, each after its index within its part of ``at``, and where the parts' begin and end."""
    own = np.flatnonzero(n != 1)
    of = np.searchsorted(own, at)
    return np.stack([own - np.repeat(at[:-1], np.diff(of)), n[own]], axis=1).astype("u4").tobytes(), of


def _counts(often: list[bytes], sizes: list[int]) -> np.ndarray:
    """All counts of parts of ``sizes``, from their :func:`_often`."""
    out, own = np.ones(sum(sizes), "i8"), np.frombuffer(b"".join(often), "u4").reshape(-1, 2)
    first = np.cumsum(sizes) - sizes
    out[own[:, 0] + np.repeat(first, [len(x) // 8 for x in often])] = own[:, 1]
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype("i8")
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(n, first) if len(first) else np.zeros(0, "i8")


def train(texts: DataFrame, most_bytes: int = MOST_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> LanguageModel:
    """The model of all ``bytes`` of ``texts``; none give one that has seen nothing."""
    n_bytes = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    regions = regions_for(int(n_bytes))
    table = count_regions(texts, regions, bits_per_entry)
    size, n_tokens, n_words = table.agg(F.sum(F.octet_length("bits") + F.octet_length("words") * 9 / 8), F.sum("tokens"), F.sum("kinds")).first()
    model = LanguageModel(table, regions, int(n_tokens or 0), int(n_words or 0), int(size or 0))
    if model.n_bytes <= most_bytes:
        model.parts = _broadcast(model)
    return model


def _broadcast(model: LanguageModel) -> list:
    """The table's regions in order, a few megabytes at a time, so that the driver never holds more than those."""
    context, n = model.table.sparkSession.sparkContext, 1 << model.regions.bits
    step = max(1, n * PART_BYTES // max(model.n_bytes, 1))
    out = []
    for first in range(0, n, step):
        last = min(n, first + step) - 1
        rows = model.table.where(F.col("region").between(first, last)).select("region", "bits", "words", "counts").collect()
        out.append(context.broadcast(part_of(sorted(rows, key=lambda r: r["region"]), first, last)))
        del rows
    release_memory()
    return out


def model_score(token: np.ndarray, counts: np.ndarray, times: np.ndarray, levels, n_tokens: int, n_words: int) -> np.ndarray:
    """log10 probability of each text; ``times`` are the tokens' own counts, ``levels`` gives the level of any runs.

    A run's count is rounded down and a history's up, which keeps the probabilities after
    a history from adding up to more than one.
    """
    own, n = runs(token, counts), len(token)
    first = np.cumsum(counts) - counts
    level = levels(np.concatenate([[START], own.pair, own.triple]))
    start, pair, triple = level[0], level[1 : n + 1], level[n + 1 :]
    word = np.where(times > 0, levels_of(np.maximum(times, 1)), 0).astype("u1")
    p = (least_count(word) + 1) / (n_tokens + n_words + 1)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[first] = start
    p = _leaning(p, pair, history)
    history = np.zeros_like(pair)
    history[1:] = pair[:-1]
    history[~own.long] = 0
    return np.add.reduceat(np.log10(_leaning(p, triple, history)), first)


def _leaning(shorter: np.ndarray, level: np.ndarray, history: np.ndarray) -> np.ndarray:
    seen = np.where(history > 0, np.minimum(least_count(level), most_count(history)), 0)
    return np.where(history > 0, (seen + STRENGTH * shorter) / (most_count(history) + STRENGTH), shorter)


def _asked(token: np.ndarray, counts: np.ndarray, regions: Regions) -> tuple[np.ndarray, np.ndarray]:
    """All grams that :func:`model_score` asks for and all words, each sorted."""
    own = runs(token, counts)
    return np.unique(regions.narrow(np.concatenate([[START], own.pair, own.triple]))), np.unique(token)


def shard_bits(model: LanguageModel) -> int:
    """How many of the regions' bits tell those of a shard apart: as many as fit about SHARD_BYTES."""
    fit = (SHARD_BYTES << model.regions.bits) // max(model.n_bytes, 1)
    return min(model.regions.bits, max(fit, 1).bit_length() - 1)


def _with_answers(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Packs of ``rows`` (doc_id, held_out, bytes), as arrays, with ``parts``: (shard, levels, counts) of the pack's sorted grams and words.

    The rows of a shard's regions come before the packs' in one sorted partition, so a task
    has one shard in memory; a gram goes out once for each pack and comes back as one byte.
    Shards are of about one size and many fewer than regions, and the requests of many packs
    are looked up together, so that the number of requests costs little.
    """
    regions, low = model.regions, shard_bits(model)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["bytes"].tolist()
            for a, b in blocks(data, PACK_BYTES):
                own = {c: [pdf[c].iloc[a:b].tolist()] for c in ("doc_id", "held_out", "bytes")}
                yield pd.DataFrame({"pack": [uuid.uuid4().hex], **own})

    packs = cut(rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(gather, "pack string, doc_id array<string>, held_out array<boolean>, bytes array<binary>"), "packs")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1 << regions.bits, dtype="u8") << np.uint64(64 - regions.bits)
        for pdf in batches:
            for pack, texts in zip(pdf["pack"], pdf["bytes"], strict=True):
                grams, word = _asked(*tokens(list(texts)), regions)
                at, of = (np.append(np.searchsorted(x, edges), len(x)) for x in (grams, word))
                sizes, packed, data = np.diff(at).astype("u4").reshape(-1, 1 << low), regions.packed(grams), word.tobytes()
                cuts = zip(*_ends(at[:: 1 << low]), *_ends(of[:: 1 << low]), strict=True)
                out = [(r, pack, -1, packed[6 * i : 6 * j], data[8 * k : 8 * m], sizes[r].tobytes()) for r, (i, j, k, m) in enumerate(cuts) if i < j or k < m]
                yield pd.DataFrame(out, columns=["shard", "pack", "region", "grams", "words", "counts"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, own = -1, [], None

        def looked_up(asked: list) -> list[tuple]:
            sizes = np.concatenate([np.frombuffer(x.counts, "u4") for x in asked])
            of = np.repeat(np.tile(np.arange(at << low, at + 1 << low), len(asked)), sizes)
            level = own.levels(regions.unpacked(b"".join(x.grams for x in asked), of), regions).tobytes()
            count = own.counts(np.frombuffer(b"".join(x.words for x in asked), "u8")).astype("i8").tobytes()
            grams, words = (np.cumsum([0, *(len(x) for x in each)]) for each in ([x.grams for x in asked], [x.words for x in asked]))
            return [(x.pack, at, level[i // 6 : j // 6], count[k:m]) for x, i, j, k, m in zip(asked, *_ends(grams), *_ends(words), strict=True)]

        for pdf in batches:
            out, asked, n = [], [], 0
            for x in pdf.itertuples(index=False):
                if asked and (x.shard != at or n > 6 * LOOKUP):
                    out += looked_up(asked)
                    asked, n = [], 0
                if x.shard != at:
                    at, held, own = x.shard, [], None
                if x.pack == "":
                    held.append({"region": x.region, "bits": x.grams, "words": x.words, "counts": x.counts})
                    continue
                if own is None:
                    own, held = part_of(held, at << low, (at + 1 << low) - 1), []
                asked.append(x)
                n += len(x.grams)
            if asked:
                out += looked_up(asked)
            yield pd.DataFrame(out, columns=["pack", "shard", "levels", "counts"])
        release_memory()

    asked = packs.select("pack", "bytes").mapInPandas(ask, "shard int, pack string, region int, grams binary, words binary, counts binary")
    met = model.table.select(F.shiftright("region", low).alias("shard"), F.lit("").alias("pack"), "region", F.col("bits").alias("grams"), "words", "counts").unionByName(asked)
    order = ["shard", "pack", "region"]
    answered = met.repartition(2 << regions.bits - low, "shard").sortWithinPartitions(*order).mapInPandas(answer, "pack string, shard int, levels binary, counts binary")
    parts = answered.groupBy("pack").agg(F.collect_list(F.struct("shard", "levels", "counts")).alias("parts"))
    return packs.join(parts.hint("merge"), "pack")


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, held_out, text).

    Null and empty texts have one token, their end.  Rows are independent, so repeated
    ones and null ids are scored alike; extra columns are ignored; an empty table gives an
    empty result.  The model is broadcast while it is small, else asked shard by shard.
    """
    n, v, regions = model.n_tokens, model.n_words, model.regions
    rows = docs.select("doc_id", "held_out", bytes_of(F.col("text")).alias("bytes"))

    def scored(out: pd.DataFrame, token: np.ndarray, counts: np.ndarray, own: WholeModel | Answers) -> pd.DataFrame:
        starts, c = np.cumsum(counts) - counts, own.counts(token)
        return out.assign(
            n_tokens=counts,
            n_known=np.add.reduceat((c > 0).astype("i8"), starts),
            train_tokens=n,
            base_score=np.add.reduceat(np.log10((c + 1) / (n + v + 1)), starts),
            score=model_score(token, counts, c, own.levels, n, v),
        )

    schema = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if model.parts is not None:
        shared = LanguageModel(None, regions, n, v, model.n_bytes, model.parts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release_memory()
            own = shared.at_hand()
            for pdf in batches:
                data = pdf["bytes"].tolist()
                for a, b in blocks(data, SCORE_BLOCK):
                    yield scored(pdf.iloc[a:b].drop(columns="bytes"), *tokens(data[a:b]), own)
            release_memory()

        return map_rows(rows, run, schema)

    def run_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples():
                token, counts = tokens(list(x.bytes))
                parts = sorted(x.parts, key=lambda p: p["shard"])
                level, count = (np.frombuffer(b"".join(p[c] for p in parts), t) for c, t in (("levels", "u1"), ("counts", "i8")))
                grams, word = _asked(token, counts, regions)
                out = pd.DataFrame({"doc_id": list(x.doc_id), "held_out": list(x.held_out)})
                yield scored(out, token, counts, Answers(grams, level, word, count, regions))
        release_memory()

    out = _with_answers(rows, model).mapInPandas(run_packs, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@in_small_batches(250)
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")).select(bytes_of(F.col("text")).alias("bytes")))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
