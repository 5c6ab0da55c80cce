import itertools
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm.packing import fullest, minimum_bin_slack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Plain words here, and MORE!", "", None, "naïve café's 12,5 €", "x" * 900, "tab\tand\x1cnew\nlines  ", "日本語 text", "a b c " * 400, "word " * 31 + "end.", "<|endoftext|> inside", "it's we'll I'd", "\x00 nul"]


@pytest.mark.parametrize("capacity", [16, 64])
def test_pieces_and_places(spark, capacity):
    rows = [(i, x, "c") for i, x in enumerate(TEXTS)] + [(None, TEXTS[0], "c"), (1 << 60 | 1, TEXTS[0], "c"), (0, TEXTS[0], "c")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), PATH, capacity).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, x, _ in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((doc_id, k, a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= sum(w[3] for w in want) / capacity * 1.1 + 1


def test_fullest_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        counts = {k: r.randint(1, 3) for k in r.sample(range(1, 15), r.randint(0, 4))}
        room = r.randint(0, 30)
        sums = {sum(k * n for k, n in zip(counts, use)) for use in itertools.product(*(range(v + 1) for v in counts.values()))}
        use = fullest(counts, room)
        assert all(0 < n <= counts[k] for k, n in use.items())
        assert sum(k * n for k, n in use.items()) == max(s for s in sums if s <= room)


def test_every_piece_is_used_once():
    r = random.Random(2)
    counts = {k: r.randint(1, 500) for k in r.sample(range(1, 65), 40)}
    used = dict.fromkeys(counts, 0)
    for p in minimum_bin_slack(counts, 64):
        assert sum(k * n for k, n in p.uses) <= 64
        for k, n in p.uses:
            used[k] += n * p.times
    assert used == counts


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_places_joined_instead_of_broadcast(spark, monkeypatch):
    import tallyforge.llm.packing as module

    monkeypatch.setattr(module, "MOST_FIRSTS", 0)
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(5)
    got = pack_documents(docs, PATH, capacity=64).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 300
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64


def test_a_packing_worker_holds_little_at_once():
    """Beside its cache, a worker holds the words of a slice; nothing that hashed texts before is left in it."""
    import tracemalloc

    import numpy as np

    from tallyforge.llm import packing, rolling
    from tallyforge.llm.common import release_memory
    from tallyforge.llm.tokens import CachedEncoder, slices

    before = rolling.PrefixHash(np.arange(300_000, dtype="u8").astype("u1")).of(np.array([7]), np.array([299_000]))
    release_memory()
    assert sum(x.nbytes for kept in rolling._POWERS for x in kept) < 1000
    assert rolling.PrefixHash(np.arange(300_000, dtype="u8").astype("u1")).of(np.array([7]), np.array([299_000])) == before
    texts, own = ["some words of text " * 500] * 400, CachedEncoder(PATH, str.split, packing._word_ids(PATH))
    tracemalloc.start()
    try:
        n = sum(len(x) for a, b in slices(texts, packing.SLICE) for x in own.encode(texts[a:b]))
        assert n == 400 * 2000 * 4 and tracemalloc.get_traced_memory()[1] < 15e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [7, 60, 500_000])
def test_new_words_are_encoded_together(most):
    """Words of letters, digits and signs don't go to the library or the cache one by one; all ids equal the library's."""
    from tallyforge.llm import packing
    from tallyforge.llm.tokens import CachedEncoder, StreamEncoder

    library, r = Tokenizer.from_file(PATH), random.Random(3)
    own = StreamEncoder(PATH, CachedEncoder(PATH, str.split, packing._word_ids(PATH)), 0, most)

    def same(texts):
        ids, ends = own.encode(texts)
        want = [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == list(itertools.chain(*want))
        assert ends.tolist() == list(itertools.accumulate(map(len, want)))

    same([" ".join("".join(r.choices("abÉßü.,&%<-07", k=r.randint(1, 9))) for _ in range(300)) for _ in range(20)])
    assert not own.others.cache
    odd = [*"abXÉß×²½'''strvmld<|>.,!-09\t\n\r\x1c\x1f\x85\xa0 \x00\x01\x02İΣς’“日́٣", *["<|endoftext|>", "'ll", "'RE", " ", " "]]
    for _ in range(100):
        same(["".join(r.choices(odd, k=r.randint(0, 50))) for _ in range(r.randint(0, 9))])
    same([x or "" for x in TEXTS] + ["x" * 1500 + " y", "ab " * 3000])
