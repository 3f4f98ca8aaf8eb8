from __future__ import annotations

import zlib

import numpy as np
from odd import no_documents, odd_documents, odd_labels
from pyspark.sql import functions as F

from riskloom.llm import quality
from riskloom.llm.queries import QUERIES


def test_held_out_accuracy_and_columns(spark, sf_dir):
    out = QUERIES["op2_pairwise_quality"](spark, sf_dir)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for doc, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_held_out_labels_are_not_used(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs.withColumn("lang", F.lit("x")), turned).collect()}
    assert a == b


def test_pairs_rank_and_the_bar_is_a_quantile():
    random = np.random.default_rng(0)
    x = random.normal(0, 1, (400, quality.N_FEATURES)).astype(np.float32)
    good = x[:, 3] + 0.1 * random.normal(0, 1, 400) > -0.8
    model = quality.fit_ranking(x, good, np.ones(400))
    u = model.utility(x)
    assert (u[good][:, None] > u[~good][None]).mean() > 0.97
    assert abs((u < model.bar).mean() - (~good).mean()) < 0.01
    s = model.score(x)
    assert ((s >= quality.CUT) == (u >= model.bar)).all() and (np.argsort(s, kind="stable") == np.argsort(u, kind="stable")).all()


def test_odd_rows(spark, small_dir):
    docs = odd_documents(spark)
    assert {r["score"] for r in quality.classify(docs, odd_labels(spark).where("quality = 1")).collect()} == {0.5}
    assert quality.classify(docs, odd_labels(spark)).count() == docs.count()
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{small_dir}/documents.parquet"), labels)
    rows = docs.select("doc_id", "text", quality.score(model, F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    assert len({r["s"] for r in rows if not r["text"]}) == 1
    assert quality.classify(no_documents(spark), odd_labels(spark)).count() == 0


def test_an_id_with_a_third_of_all_rows_is_bounded(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    hot = next(r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    copies = docs.where(F.col("doc_id") == hot).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("again")
    others = spark.range(4000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    plain = quality.labelled_sample(docs, labels, 10_000).collect()
    copied = quality.labelled_sample(docs.unionByName(copies).repartition(7), labels, 10_000).collect()
    # Copies are one row that weighs as many.
    assert len(copied) == len(plain) and sorted(r["weight"] for r in copied)[-1] == 4001
    several = quality.labelled_sample(docs.unionByName(others).repartition(7), labels, 100).collect()
    assert len(several) < 2 * 100 + 80
    assert abs(sum(r["weight"] for r in several) - (4000 + len(plain))) < 0.3 * 4000


def test_scores_equal_the_model_applied_by_hand(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = {}
    for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect():
        labels.setdefault(r["doc_id"], []).append(r["quality"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    learned = [d for d in texts if d in labels and zlib.crc32(str(d).encode()) % 5]
    x = quality.features_of([texts[d] for d in learned])
    good = np.array([np.mean(labels[d]) >= 0.5 for d in learned])
    order = np.lexsort(x[:, :24].T)
    model = quality.fit_ranking(x[order], good[order], np.ones(len(order)))
    want = dict(zip(texts, model.score(quality.features_of(list(texts.values())))))
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.read.parquet(f"{small_dir}/labels.parquet")).collect()}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_PER_CLASS", 5, raising=False)
    monkeypatch.setattr(quality, "FEW_ROWS", 20)
    texts = [(i, f"a fairly good text number {i} with words" if i % 3 else f"bad {i} !!! $$$ {i % 11} ##" + " x" * (i % 7)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 10 else i % 2) for i, _ in texts], "doc_id long, quality int")
    learned = [(t, int(i % 3 > 0) if i % 10 else i % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, *a: seen.append((rows.n_up, rows.n_down)) or fit(rows, 700))
    model = quality.train(docs, labels)
    good = np.array([g for _, g in learned], bool)
    assert seen == [(good.sum(), (~good).sum())]
    want = fit(quality.LocalRows(quality.features_of([t for t, _ in learned]), good, np.ones(len(good))), 700)
    assert np.array_equal(model.weights, want.weights) and abs(model.bar - want.bar) < 1e-8 and abs(model.slope - want.slope) < 1e-8
