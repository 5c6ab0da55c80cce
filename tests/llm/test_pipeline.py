import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm.near_dedup import ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from tallyforge.llm.common import cut

    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), "stage"))
    return out


def test_every_stage_keeps_the_columns_and_ids(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == corpus_pipeline.COLUMNS
        ids = {r[0] for r in before.select("doc_id").collect()}
        own = [r[0] for r in after.select("doc_id").collect()]
        assert len(own) == len(set(own)) > 0 and set(own) <= ids


def test_near_copies_are_gone_and_one_of_each_class_stays(stages):
    classes = {r["class_id"] for r in ngram_join(stages[2]).collect()}
    assert {r["doc_id"] for r in stages[3].select("doc_id").collect()} == classes


def test_no_long_passage_is_left_twice_in_the_input_of_the_last(stages):
    """No 51 words in a row that stood in two texts before the stage stand in two of them after it."""

    def passages(frame):
        found = {}
        for r in frame.select("doc_id", "text").collect():
            words = (r["text"] or "").split()
            for i in range(len(words) - 50):
                found.setdefault(" ".join(words[i : i + 51]), set()).add((r["doc_id"], i))
        return {x for x, places in found.items() if len(places) > 1}

    before, after = passages(stages[3]), passages(stages[4])
    assert before and not before & after
    assert stages[4].count() == stages[3].count()


ODD = [
    (1, None, None, None, None),
    (None, "a null id " * 8, "en", "s", 80),
    (None, "a null id " * 8, "en", "s", 80),
    (2, "", "fr", None, 0),
    (3, " ".join(f"w{i}" for i in range(40_000)), "de", "s", 9),
    (4, "tie\ntie\ntie", "es", "t", 11),
    (5, "tie\ntie\ntie", "es", "t", 11),
    (5, "tie\ntie\ntie", "es", "t", 11),
]


@pytest.mark.parametrize("k", range(5))
def test_stages_handle_odd_rows_and_extra_columns(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, keep_id long, spans string, selected string, length string, host string"
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", "l", "h") for r in ODD], schema)
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    rows = got.collect()
    if k < 4:
        assert got.columns == corpus_pipeline.COLUMNS
    ids = [r["doc_id"] for r in rows]
    if k in (1, 3):
        assert sorted(ids, key=str) == sorted((r[0] for r in ODD), key=str)
        assert {r["text"] for r in rows if r["doc_id"] == 1} == {None}
    if k == 2:
        assert sorted(ids, key=str) == sorted([1, None, 3, 4], key=str)
    if k == 4:
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and set(ids) == {1, None, 2, 3, 4, 5}
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).collect() == []


def test_packed_ids_are_those_of_the_last_texts(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    packed = {}
    for r in stages[5].collect():
        packed.setdefault(r["doc_id"], {})[r["start"]] = (r["length"], r["ids_crc32"])
    assert packed.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start, (length, crc) in packed[doc_id].items():
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])) == crc


def test_a_shared_passage_of_51_words_goes_and_shorter_ones_stay(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    long, short, tiny = words("p", 51), words("q", 45), " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in [*range(26), *range(1, 51, 2)])
    texts = [f"{words(f'{x}a', 60)} {long} {words(f'{x}b', 60)} {short} {words(f'{x}c', 60)} {tiny} {words(f'{x}d', 60)}" for x in ("one", "two")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in corpus_pipeline.drop_passages(spark, docs, SF).collect()]
    assert len(got) == 2
    assert all(long not in x and tiny not in x and short in x for x in got)


def test_short_repeats_side_by_side_stay(spark):
    """Three phrases of 20 words, each of which another document has, are no passage of 51 words that another one has."""
    words = lambda name, n: " ".join(f"{name}{i}-longer" for i in range(n))
    phrases = [words(x, 20) for x in "pqr"]
    texts = [f"{words('a', 30)} {' '.join(phrases)} {words('b', 30)}", *(f"{words(f'own{i}', 70)} {p} {words(f'end{i}', 70)}" for i, p in enumerate(phrases))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_passages(spark, docs, SF).collect()} == dict(enumerate(texts))


def test_runs_leave_each_others_tables(spark):
    from tallyforge.llm.common import cut, drop_tables, owned_by

    with owned_by("stage 1", run="one"):
        mine = cut(spark.range(5), "mine")
    with owned_by("stage 1", run="two"):
        other = cut(spark.range(7), "other")
    drop_tables(spark, "stage 1", run="one")
    assert other.count() == 7
    with pytest.raises(Exception):
        mine.count()
