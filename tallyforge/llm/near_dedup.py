"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set comparison decides.

Each tree of the forest names a text by a label of LONGEST MinHash values.  Sorted labels
are a trie: texts that follow each other share a prefix, and those under one node follow
each other.  In each tree every text matches the longest prefix it shares with a text
before it and links itself to the first text under that node, which lists no pairs; so
prefixes are as long as each text's nearest match allows.  They are shortened down to the
length at which a pair at the threshold is found with the target recall by reckoning
(:func:`depth_for`), and from there one by one as long as the links that a shorter prefix
adds, all of them compared exactly, show that a similar pair was missed
(:func:`adapted_links`).  Links make components; within a component all pairs are then
compared exactly, by blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, in_small_batches, join_spread, release_memory
from .components import connected_components
from .rolling import blocks, mix, words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
LONGEST = 8
RECALL = 0.9999
#: Prefixes are not shortened beyond this; each value has 16 bits.
SHORTEST = 3
#: Texts that links name, up to which their names are sent to the texts rather than shuffled with them.
MOST_NAMES = 500_000
#: Labels that one task sorts.
SORT_ROWS = 250_000
#: Shingle bytes and texts of a component that are compared in one task; larger ones are compared block by block.
GROUP_BYTES = 8_000_000
GROUP_TEXTS = 512
#: Shingles compared at once; bounds memory alone.
COLUMNS = 4096


def chance(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """That a pair at ``threshold`` shares a prefix of ``depth`` values in one of the trees at least."""
    return 1 - (1 - threshold**depth) ** trees


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words (with repeats) and how many each text has.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    word, counts = words(texts)
    step = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(word) - size + 1)
    run = word[:n].copy()
    for i in range(1, size):
        run = mix(run * step + word[i : n + i])
    ends = np.cumsum(counts)
    inside = np.zeros(len(word) + 1, "i4")
    long = counts >= size
    np.add.at(inside, (ends - counts)[long], 1)
    np.add.at(inside, (ends - size + 1)[long], -1)
    short = np.flatnonzero((counts > 0) & ~long)
    if not len(short):
        return run[np.cumsum(inside)[:n] > 0], np.where(long, counts - size + 1, 0)
    whole = []
    for i in short:
        x = np.uint64(counts[i])
        for y in word[ends[i] - counts[i] : ends[i]]:
            x = mix(np.array([x]) * step + y)[0]
        whole.append(x)
    owner = np.concatenate([np.repeat(np.arange(len(texts)), np.where(long, counts - size + 1, 0)), short])
    values = np.concatenate([run[np.cumsum(inside)[:n] > 0], np.array(whole, "u8")])
    return values[np.argsort(owner, kind="stable")], np.where(long, counts - size + 1, np.minimum(counts, 1))


def forest_labels(values: np.ndarray, counts: np.ndarray, trees: int, longest: int) -> np.ndarray:
    """For each text with shingles its label in each tree: ``longest`` values of 16 bits (text, tree, value)."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    seeds = mix(np.arange(1, trees * longest + 1, dtype="u8")) | np.uint64(1)
    out = np.empty((len(starts), trees * longest), ">u2")
    for i, seed in enumerate(seeds):
        out[:, i] = mix(np.minimum.reduceat(values * seed, starts)) >> np.uint64(48)
    return out.reshape(len(starts), trees, longest)


def sorted_links(batches: Iterator[pd.DataFrame], partition: int, longest: int, shortest: int) -> Iterator[pd.DataFrame]:
    """Links (a, b, depth) within one partition of sorted (tree, label, node), and its ends.

    ``b`` is the first text under the deepest node in which ``a`` follows another.  The ends,
    by which partitions are joined later, have the place 1 (first row) and 2 (last).
    """
    columns = ["partition", "place", "tree", "label", "a", "b", "depth"]
    before, heads = None, np.zeros(longest + 1, object)
    for pdf in batches:
        if not len(pdf):
            continue
        tree, nodes, labels = pdf["tree"].to_numpy(), pdf["node"].to_numpy(), pdf["label"].to_numpy()
        values = np.frombuffer(b"".join(labels), ">u2").reshape(len(pdf), longest)
        same = np.zeros((len(pdf), longest), bool)
        same[1:] = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        if before is not None:
            same[0] = (values[0] == np.frombuffer(before[1], ">u2")) & (tree[0] == before[0])
        else:
            yield pd.DataFrame([(partition, 1, tree[0], labels[0], nodes[0], None, 0)], columns=columns)
        depth = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        head = np.empty(len(pdf), object)
        for d in range(1, longest + 1):
            first = np.maximum.accumulate(np.where(depth < d, np.arange(len(pdf)), -1))
            own = depth == d
            head[own] = np.where(first[own] >= 0, nodes[np.maximum(first[own], 0)], heads[d])
            if first[-1] >= 0:
                heads[d] = nodes[first[-1]]
        before = tree[-1], labels[-1], nodes[-1]
        own = depth >= shortest
        yield pd.DataFrame({"partition": partition, "place": 0, "tree": tree[own], "label": None, "a": nodes[own], "b": head[own], "depth": depth[own]}, columns=columns)
    if before is not None:
        yield pd.DataFrame([(partition, 2, *before, None, 0)], columns=columns)
    release_memory()


def forest_links(labels: DataFrame, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """tree, a, b and depth of the links between texts that meet in a tree of (tree, label, node) at ``shortest`` values or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return sorted_links(batches, TaskContext.get().partitionId(), longest, shortest)

    order = ["tree", "label", "node"]
    dealt = labels.repartitionByRange(max(1, labels.count() // SORT_ROWS), *order).sortWithinPartitions(*order)
    schema = "partition int, place int, tree int, label binary, a binary, b binary, depth int"
    met = cut(dealt.select(*order).mapInPandas(run, schema), "tries")
    ends = Window.orderBy("partition", "place")  # two rows a partition
    last = met.where("place > 0").select("*", *(F.lag(c).over(ends).alias(f"{c}_") for c in ("tree", "label", "a"))).where("place = 1 AND tree = tree_")
    shared = F.greatest(F.lit(0), *(F.when(F.substring("label", 1, 2 * d) == F.substring("label_", 1, 2 * d), d) for d in range(1, longest + 1)))
    across = last.select("tree", "a", F.col("a_").alias("b"), shared.alias("depth")).where(F.col("depth") >= shortest)
    return met.where("place = 0").select("tree", "a", "b", "depth").unionByName(across)


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = LONGEST, shortest: int = SHORTEST) -> int:
    """How far prefixes are shortened: the greatest depth at which ``trees`` find a pair at ``threshold`` with chance ``recall``."""
    depth = longest
    while depth > shortest and chance(depth, threshold, trees) < recall:
        depth -= 1
    return depth


def similar_pairs(pairs: DataFrame, texts: DataFrame, signed_texts: DataFrame, size: int, threshold: float) -> int:
    """How many of ``pairs`` (a, b), which may repeat, are at ``threshold`` or more; all are compared."""
    pairs = cut(pairs.distinct(), "pairs")
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(signed_texts.select("node", "row"), "node"), "named")
    n = nodes.count()
    if not n:
        return 0

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["bytes"].tolist()
            for a, b in blocks(data):
                values, counts = shingles(data[a:b], size)
                ends = np.cumsum(counts)
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "set": [np.unique(values[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]})
        release_memory()

    own = texts.join(nodes.hint("broadcast" if n <= MOST_NAMES else "merge"), ["node", "row"]).mapInPandas(sets, "node binary, set binary")
    held = cut(own.groupBy("node").agg(F.first("set").alias("set")), "compared")
    named = pairs
    for end in ("a", "b"):
        sized = held.select(F.col("node").alias(end), (F.octet_length("set") / 8).alias(f"n_{end}"))
        named = named.join(sized, end)
    # sets of too different sizes can't be similar
    close = cut(named.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9).select("a", "b"), "close")
    total = close.count()

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both > 0 and both / (len(x) + len(y) - both) >= threshold

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")

    met = join_spread(close, held.select(F.col("node").alias("a"), F.col("set").alias("sa")), ["a"], None, ["b"], total)
    met = join_spread(met, held.select(F.col("node").alias("b"), F.col("set").alias("sb")), ["b"], None, ["a"], total)
    return met.where(similar("sa", "sb")).count()


def adapted_links(met: DataFrame, texts: DataFrame, signed_texts: DataFrame, size: int, threshold: float, trees: int, recall: float) -> DataFrame:
    """node and root of the components that the links ``met`` (a, b, depth) make, by prefixes as short as they need be.

    A length is short enough if none of the links that one value less would add between
    different components is similar.
    """
    depth = depth_for(threshold, trees, recall)
    while True:
        parts = cut(connected_components(met.where(F.col("depth") >= depth).select("a", "b")), "parts")
        if depth <= SHORTEST:
            return parts
        more = met.where(F.col("depth") == depth - 1).select("a", "b")
        for end in ("a", "b"):
            own = parts.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            more = more.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        if not similar_pairs(more.where("root_a <> root_b").select("a", "b"), texts, signed_texts, size, threshold):
            return parts
        depth -= 1


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted, without repeats) have a Jaccard similarity of ``threshold`` or more; no set links itself."""
    sizes = np.array([len(x) for x in sets], "f8")
    names, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype("i8"))
    wide = np.cumsum(often > 1) - 1  # only what several have can be shared
    keep = often[column] > 1
    owner, column = owner[keep], wide[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), "f4")
    for a in range(0, int(wide[-1]) + 1 if len(wide) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        some = np.zeros((len(sets), min(COLUMNS, int(wide[-1]) + 1 - a)), "f4")
        some[owner[i:j], column[i:j] - a] = 1
        shared += some @ some.T
    union = sizes[:, None] + sizes[None, :] - shared
    out = (shared >= 1) & (shared / np.maximum(union, 1) >= threshold)
    np.fill_diagonal(out, False)
    return out


def _least_linked(linked: np.ndarray) -> np.ndarray:
    """For each member the least member of its component."""
    least = np.arange(len(linked))
    while True:
        of = np.where(linked, least[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(least, of)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _digest(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


_FOUND = "node binary, label binary, links long"


def _compare(pdf: pd.DataFrame, threshold: float, cross: bool = False) -> pd.DataFrame:
    """Links and components within each root of (root, node, side, set); if ``cross``, only the links from side to side (none if one is empty)."""
    out = []
    for _, own in pdf.groupby("root", sort=False):
        own = own.drop_duplicates("node").sort_values("node")
        linked = links([np.frombuffer(x, "u8") for x in own["set"]], threshold)
        side = own["side"].to_numpy()
        if cross:
            linked &= side[:, None] != side[None, :]
        nodes = own["node"].to_numpy()
        out.append(pd.DataFrame({"node": nodes, "label": nodes[_least_linked(linked)], "links": linked.sum(axis=1)}))
    return pd.concat(out)


def near_links(texts: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, group_bytes: int = GROUP_BYTES, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """node, label, links: of each text (node, row, bytes; copies may repeat) that met another one, its class and number of links."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = pdf["bytes"].tolist()
            for a, b in blocks(data):
                values, counts = shingles(data[a:b], size)
                if len(values):
                    own = pdf.iloc[a:b][["node", "row"]][counts > 0]
                    yield own.assign(labels=[x.tobytes() for x in forest_labels(values, counts, trees, LONGEST)])
        release_memory()

    signed_texts = texts.mapInPandas(sign, "node binary, row long, labels binary").groupBy("node").agg(F.first("labels").alias("labels"), F.min("row").alias("row"))
    signed_texts = cut(signed_texts, "signatures")
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.col("labels").substr(t * (2 * LONGEST) + 1, F.lit(2 * LONGEST)).alias("label")))
    met = cut(forest_links(signed_texts.select("node", F.explode(each).alias("x")).select("x.tree", "x.label", "node"), LONGEST, SHORTEST).select("a", "b", "depth"), "links")
    parts = adapted_links(met, texts, signed_texts, size, threshold, trees, recall).join(signed_texts.select("node", "row").hint("merge"), "node")

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            node = pdf["node"].to_numpy()
            fresh = np.array([x != y for x, y in zip(node, [before, *node[:-1]], strict=True)], bool)  # rows repeated whole follow each other
            before = node[-1] if len(node) else before
            own = pdf[fresh]
            data = own["bytes"].tolist()
            for a, b in blocks(data):
                values, counts = shingles(data[a:b], size)
                ends = np.cumsum(counts)
                yield own.iloc[a:b][["node", "root"]].assign(set=[np.unique(values[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)])
        release_memory()

    one_each = texts.join(parts.hint("merge"), ["node", "row"])  # one row of each text, wherever its copies are
    sets = cut(one_each.select("node", "root", "bytes").mapInPandas(collect, "node binary, root binary, set binary"), "sets")
    sizes = sets.groupBy("root").agg(F.sum(F.octet_length("set")).alias("size"), F.count(F.lit(1)).alias("texts"))
    grid = F.greatest(F.ceil(F.col("size") / group_bytes), F.ceil(F.col("texts") / group_texts)).cast("int")
    sized = cut(sizes.select("root", "size", "texts", grid.alias("grid")), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    placed = join_spread(sets, sized.select("root", "texts", "grid"), ["root"], "texts", ["node"], sets.count())
    shard = F.pmod(F.xxhash64("root"), F.lit(max(1, total // group_bytes * 2)))
    small = placed.where("grid = 1").select(shard.alias("shard"), "root", "node", F.lit(0).alias("side"), "set")
    found = small.groupBy("shard").applyInPandas(lambda pdf: _compare(pdf, threshold), _FOUND)
    if sized.where("grid > 1").isEmpty():
        return found
    own = F.pmod(F.xxhash64("node"), F.col("grid")).cast("int")
    spread = placed.where("grid > 1").select("root", "node", "set", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("other"))
    pairs = spread.select("root", "node", "set", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    across = cut(pairs.groupBy("root", "i", "j").applyInPandas(lambda pdf: _compare(pdf, threshold, cross=bool(pdf["i"].iloc[0] != pdf["j"].iloc[0])), _FOUND), "across")
    labels = connected_components(across.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counted = across.groupBy("node").agg(F.sum("links").alias("links"))
    return found.unionByName(counted.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "links"))


def _row(docs: DataFrame) -> Column:
    """A number that tells the rows of one text apart by their ids."""
    return F.xxhash64(docs["doc_id"], F.lit(0))


def near_classes(docs: DataFrame, **parameters) -> DataFrame:
    """node (digest of the text), doc_id, class (a node) and n_links of each row of ``docs``."""
    data = bytes_of(docs["text"])
    found = cut(near_links(docs.select(_digest(data).alias("node"), _row(docs).alias("row"), data.alias("bytes")), **parameters), "found")
    rows = cut(docs.select("doc_id", _digest(data).alias("node")), "nodes")
    named = join_spread(rows, found, ["node"], None, ["doc_id"], rows.count(), "left")
    return named.select("node", "doc_id", F.coalesce("label", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("n_links"))


def ngram_join(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id and n_links of each row of ``docs``.

    Two different texts are linked if their sets of word 5-shingles (words end at ASCII
    white space; fewer words make one shingle) have a Jaccard similarity of 0.8 or more.
    ``n_links`` counts the different texts that a text is linked to; ``class_id`` is the least
    doc_id among all rows whose texts are joined by links, copies of a text included (null
    only if all are null).  Null text counts as empty; texts without words have no links;
    repeated rows are rows of one class; extra columns are ignored; an empty table gives
    an empty result.
    """
    rows = cut(near_classes(docs, **parameters), "classes")
    least = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return join_spread(rows, least, ["class"], "n", ["doc_id", "node"], rows.count()).select("doc_id", "class_id", "n_links")


def near_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each class of :func:`ngram_join`, that of the least doc_id (null counts as greatest, then the least digest).

    Of rows repeated with the same text and id one stays.  All columns are kept, whatever
    their names; see :func:`ngram_join` for nulls and empty texts and tables.
    """
    rows = cut(near_classes(docs.select("doc_id", "text"), **parameters), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")
    keep = rows.groupBy("class").agg(F.min(order).alias("keep")).select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.node").alias("keep_node"))
    repeated = not rows.groupBy("doc_id", "node").count().where("count > 1").isEmpty()
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("own_id"), _digest(bytes_of(docs["text"])).alias("own_node"))
    out = own.join(keep.hint("merge"), (F.col("own_node") == F.col("keep_node")) & F.col("own_id").eqNullSafe(F.col("keep_id")), "left_semi")
    out = out.dropDuplicates(["own_id", "own_node"]) if repeated else out
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


@in_small_batches()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
