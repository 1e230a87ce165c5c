import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import SF  # noqa: F401
from pyspark.sql import functions as F

from evigraph.llm import langid
from evigraph.llm.queries import op1_language


def brute_tree(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        data = b"\n" * order + t.encode()
        for i in range(order, len(data)):
            for d in range(order + 1):
                tree[data[i - d : i]][data[i]] += 1
    return tree


def brute_bits(tree, text, order):
    data, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for d in range(order, -1, -1):
            seen = tree.get(data[i - d : i])
            if seen:
                total = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits += math.log2(total / seen[data[i]])
                    break
                bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_match_plain_trees(spark):
    train = {"en": ["the cat sat on the mat", "then the hat"], "de": ["der hund und die katze", "über den zaun"]}
    rows = [(i, t, lang) for lang, ts in train.items() for i, t in enumerate(ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=3)
    texts = ["the hut", "", "über 漢字 the", "zzz", "the cat " * 400]
    got = langid.Scorer(model).lengths(pa.array(texts), step=64)
    assert model.langs == ["de", "en"]
    for k, lang in enumerate(model.langs):
        tree = brute_tree(train[lang], 3)
        for i, t in enumerate(texts):
            assert got[i, k] / langid.UNIT == pytest.approx(brute_bits(tree, t, 3), abs=1e-5 * (len(t) + 1) * 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = op1_language(spark, SF).join(docs, "doc_id")
    held = got.where("held_out").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert held["n"] > 20 and held["ok"] >= 0.95 * held["n"]
    assert got.where("score < 0 or score > 1").isEmpty() and got.count() == docs.count()


def test_odd_texts(spark, odd, clash):
    model = langid.train(spark.createDataFrame([(1, "the cat", "en"), (2, "die katze", "de"), (3, "no label", None), (4, None, "fr")], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] or "fr" in model.langs
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")), r
    out = langid.predict(clash, model)
    assert out.columns.count("score") == 1 and out.where("value = 'mine'").count() == clash.count()
    empty = odd.limit(0)
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty.withColumn("lang", F.lit("en")))
    assert none.langs == [] and {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_equal_code_lengths_go_to_the_first_language(spark):
    model = langid.train(spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string"))
    row = langid.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "a" and row["score"] == pytest.approx(0.5)


def test_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("lang"))
    got = {r["lang"]: r["count"] for r in langid.training_sample(df, "text", "lang", "doc_id", 50, 100).groupBy("lang").count().collect()}
    assert got == {"hot": 50, "cold": 50}


def test_every_labelled_language_is_learned(spark):
    """Texts beyond the bound of characters and rows without an id leave no language out."""
    rows = [(i, "kurze saetze hier", "de") for i in range(300)] + [(1000 + i, f"{i} the long text goes on " * 2000, "en") for i in range(5)] + [(None, f"un texte sans numero {i}", "fr") for i in range(1500)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id", 256, 20_000)
    got = {r["lang"]: (r["n"], r["longest"]) for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).collect()}
    assert got["de"][0] == got["fr"][0] == 256 and got["en"] == (5, 20_000)
