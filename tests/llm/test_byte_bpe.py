import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import byte_bpe
from tallyforge.llm.byte_bpe import TreeEncoder, digests, encode_decode, encode_long_word
from tallyforge.llm.tokens import packed

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(1)
    odd = ["", None, " ", "\n\n  x", "it's  naïve café x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "x\x1cy\x1f z", "日本語のテキスト " * 20, "\x00\x85  x", "🙂🙂👩‍👩‍👧"]
    long = ["".join(r.choice("abcdefgh") for _ in range(20_000)), "a" * 9000, "ab" * 5000, "é日" * 3000, "1" * 5000 + "." * 5000, "http://" + "".join(r.choice("ab/.-_0") for _ in range(6000))]
    long += [f"a b\n\n{long[0]}  c", f"a \t {'x' * 3000}\n\n y", f"!\x1c{'z' * 3000}\x1f "]
    long += [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(20_000)), "x" * 5000 + " <|endoftext|> " + "word " * 9000]
    mixed = ["".join(r.choice(" \n\tabcé.1'🙂") for _ in range(r.randint(1, 80))) for _ in range(300)]
    return odd + long + mixed


def test_equals_the_library(spark):
    rows = [(i if i % 7 else None, x, "z") for i, x in enumerate(texts())]
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, x, _ in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = digests(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_tree_of_small_leaves(leaf):
    library = Tokenizer.from_file(PATH)
    r = random.Random(leaf)
    for _ in range(60):
        word = "".join(r.choice("theanding'1.é") for _ in range(r.randint(1, 300)))
        assert encode_long_word(PATH, word, leaf) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [2, 5, 16, 64])
def test_tree_of_small_leaves_over_whole_texts(leaf):
    library, own, r = Tokenizer.from_file(PATH), TreeEncoder(PATH, leaf, window=3), random.Random(leaf)
    parts = ["the", "'s", "'", "ll", " ", "  ", "\n", "\t", "1", "23", ".", "é", "日", "🙂", "ing", "ST", " a", "\u3000", "\x85", "\x1c"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 120)))
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)
    assert own.tree.joins > 300


def test_documents_are_joined_from_halves(spark):
    library, own = Tokenizer.from_file(PATH), TreeEncoder(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for (text,) in rows:
        assert own.encode(text or "") == packed(library.encode(text or "", add_special_tokens=False).ids)
    assert own.tree.joins > 100


def test_halves_as_rows_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, digests(docs, PATH).collect()))
    monkeypatch.setattr(byte_bpe, "PARALLEL", 1000)
    assert sorted(map(tuple, digests(docs, PATH).collect())) == want


def test_round_trip_and_empty_table(spark):
    rows = [(i, x) for i, x in enumerate(texts()) if x is not None]
    got = {r["doc_id"]: r["decoded"] for r in encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == dict(rows)
    assert digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
