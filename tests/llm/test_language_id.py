import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm.common import crc_mod
from tallyforge.llm.language_id import ORDER, predict, train

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": ["the", "and", "house", "with"], "de": ["der", "und", "haus", "mit"], "fr": ["le", "été", "maison", "avec"]}


def corpus():
    r = random.Random(1)
    rows = []
    for i in range(300):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 30))), lang, "s"))
    return rows


def code_length(texts, text):
    """Bits of a text by contexts of up to ORDER bytes with method C escapes, counted plainly."""
    pad = b"\n" * ORDER
    counts = Counter()
    for x in texts:
        x = pad + x
        for i in range(ORDER, len(x)):
            for k in range(ORDER + 1):
                counts[x[i - k : i], x[i]] += 1
    total, kinds = Counter(), Counter()
    for (context, _), n in counts.items():
        total[context] += n
        kinds[context] += 1
    bits, x = 0.0, pad + text
    for i in range(ORDER, len(x)):
        for k in range(ORDER, -1, -1):
            c = x[i - k : i]
            if counts[c, x[i]]:
                bits -= math.log2(counts[c, x[i]] / (total[c] + kinds[c]))
                break
            if total[c]:
                bits -= math.log2(kinds[c] / (total[c] + kinds[c]))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(spark):
    rows = corpus()[:60]
    model = train(spark.createDataFrame(rows, SCHEMA))
    probes = [b"the house", "été mit xyz".encode(), b"", b"zzzz", b"\x00\xff"]
    got = model.code_lengths(probes)
    for i, lang in enumerate(model.langs):
        own = [x.encode() for _, x, y, _ in rows if y == lang]
        for j, p in enumerate(probes):
            assert math.isclose(got[j, i], code_length(own, p), rel_tol=1e-4, abs_tol=1e-3)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = train(docs.where(~F.col("held_out")))
    got = predict(docs.select("doc_id", "lang", "held_out", "text"), model).where("held_out").collect()
    assert len(got) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "123 !?"), ((1 << 60) + 1, "the and the"), (2, "123 !?")], "doc_id long, text string")
    out = sorted(map(tuple, predict(odd, model).collect()), key=str)
    assert [r[:2] for r in out] == sorted([(1, "und"), (None, "und"), (2, "und"), (2, "und"), ((1 << 60) + 1, "en")], key=str)
    assert all(0 <= r[2] <= 1 for r in out)


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    named = docs.select("doc_id", "text", F.lit("old").alias("lang_pred"), "score", F.lit(1).alias("lettered"), F.lit(2).alias("row"))
    out = predict(named, train(docs))
    assert out.columns == ["doc_id", "lettered", "row", "lang_pred", "score"]
    assert {r["lang_pred"] for r in out.collect()} == set(WORDS)


def test_a_language_of_few_long_texts_is_learned(spark):
    rows = [(i, "der und haus mit " * 20_000, "de", "") for i in range(2)] + [(10 + i, "the and house with", "en", "") for i in range(20)]
    model = train(spark.createDataFrame(rows, SCHEMA), train_bytes=40_000)
    assert model.langs == ["de", "en"]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = train(none)
    assert predict(none.select("doc_id", "text"), model).collect() == []
    assert predict(spark.createDataFrame([(1, "the")], "doc_id long, text string"), model).first()["lang_pred"] == "und"


def test_long_text_in_blocks(spark, monkeypatch):
    import tallyforge.llm.language_id as m

    model = train(spark.createDataFrame(corpus(), SCHEMA))
    text = "the house und été ".encode() * 50
    whole = model.code_lengths([text])
    monkeypatch.setattr(m, "BLOCK", 37)
    assert abs(model.code_lengths([text]) - whole).max() < 0.5
