from __future__ import annotations

import zlib

import numpy as np
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from riskloom.llm import language
from riskloom.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_language_kernel"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"]:
            held.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert np.mean(held) > 0.97


def test_held_out_languages_are_not_used(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang")).otherwise("zz"))
    a, b = (sorted(map(str, language.identify(d).collect())) for d in (docs, hidden.withColumn("source", F.lit("x"))))
    assert a == b


def test_presence_is_of_whole_texts():
    a, b = language.presence(["abc", "x" * 50_000 + "abc"])
    assert (b >= a).all()
    assert (language.presence(["ABC"]) == language.presence(["abc"])).all()
    assert language.presence(["", "a"]).sum(1).tolist() == [0, 1]


def test_kernel_is_the_normalised_count_of_common_grams():
    x = language.presence(["some words here", "words"])
    want = (x[0] * x[1]).sum() / np.sqrt(x[0].sum() * x[1].sum())
    assert np.isclose(language.kernels(x, x)[0, 1], want) and np.allclose(np.diag(language.kernels(x, x)), 1)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = next(x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"])
        if r["doc_id"] is not None and not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}
    assert language.identify(no_documents(spark)).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"en"}


def test_an_id_with_a_third_of_all_rows_is_bounded(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang")
    hot = next(r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"])
    copies = docs.where(F.col("doc_id") == hot).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("again")
    plain = sorted(map(str, language.training_sample(docs).collect()))
    assert sorted(map(str, language.training_sample(docs.unionByName(copies).repartition(7)).collect())) == plain
    others = spark.range(4000).select(
        F.lit(hot).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert language.training_sample(docs.unionByName(others).repartition(7), 100).count() < 160


def test_predictions_equal_the_model_applied_by_hand(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    learned = sorted(
        (lang, np.packbits(language.presence([text])[0].astype(bool)).tobytes()) for d, (text, lang) in rows.items()
        if lang is not None and text is not None and zlib.crc32(str(d).encode()) % 5)
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in learned), np.uint8).reshape(len(learned), -1), axis=1).astype(np.float32)
    model = language.fit_languages(x, [lang for lang, _ in learned])
    names, scores = model.judge([t or "" for t, _ in rows.values()], language._unpack(model.landmarks))
    want = dict(zip(rows, zip(names, scores)))
    for r in language.identify(docs).collect():
        name, score = want[r["doc_id"]]
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-5
