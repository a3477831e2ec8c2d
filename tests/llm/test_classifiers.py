"""Held-out accuracy of the classifiers, their identities, and the rows that they must survive."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixture_corpus import SCHEMA, prose

from tessera.llm import quality, toxicity


def labelled(seed=2, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randint(20, 120))
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        if toxic:
            w = t.split(" ")
            for _ in range(max(2, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorkish", "zorkoba", "zorkan", "worthless"]))
            t = " ".join(w)
        if not good:
            t = " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in t.split(" "))
        docs.append((i, t, "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


@pytest.mark.parametrize(("run", "folds", "held", "at"), [(toxicity.toxicity, 3, 1, 1), (quality.quality, 5, 0, 0)])
def test_held_out_accuracy(spark, frames, run, folds, held, at):
    docs, labels, truth = frames
    got = run(spark, docs, labels).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in got)
    own = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in own]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark, frames):
    docs, labels, _ = frames
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    other = labels.withColumn("toxic", F.when(fold == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(spark, docs, x).collect()) for x in (labels, other))
    assert a == b


def test_sum_of_squares_identity():
    """The linear-time score equals the sum over all pairs of features."""
    texts = pa.array(["one two two three.", "Four five\nsix SEVEN", "a"])
    y = np.array([1, 0, 1])
    model = quality.train(texts, y, np.ones(3), epochs=2)
    row, bucket, stats = quality.described(texts)
    bins = model.features(stats)
    for i in range(3):
        own = bucket[row == i]
        feats = [(b, 1 / len(own)) for b in own] + [(b, 1.0) for b in bins[i]]
        z = model.w0 + sum(model.w[f] * x for f, x in feats)
        z += sum(float(model.v[f] @ model.v[g]) * x * u for k, (f, x) in enumerate(feats) for g, u in feats[:k])
        assert abs(1 / (1 + np.exp(-z)) - model(texts)[i]) < 1e-9


def test_metadata_counts(spark):
    """Texts that say nothing: only a number, or a word, beside them tells the classes apart."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 30), rng.random() < 0.5) for i in range(600)]
    docs = spark.createDataFrame([(i, t, float(rng.gauss(3 if g else -3, 1)), "a" if g else "b", None) for i, t, g in rows], "doc_id long, text string, m0_ double, kind string, gap int")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    truth = {i: g for i, _, g in rows}
    for names in (("m0_",), ("kind", "gap")):
        got = [r for r in quality.quality(spark, docs, labels, cut=0.5, metadata=names).collect() if r["held_out"]]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.9
    kept = quality.accepted(spark, docs, labels, cut=0.5, metadata=("kind",))
    assert kept.columns == docs.columns and np.mean([truth[r["doc_id"]] for r in kept.collect()]) > 0.9


def test_toxicity_score_against_brute_force():
    """A score is the logistic of the summed weights of the patterns that a text holds, each as often as it does."""
    docs, labels = labelled(n=300)
    texts = [t for _, t, *_ in docs]
    model = toxicity.train(pa.array(texts), np.array([t for _, _, t in labels]), np.ones(len(labels)))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    for t in [*texts[:40], "", "idiot", "é ß", "a" * 5000]:
        found = toxicity.patterns(*(lambda d, o: (d, o))(*toxicity.K.buffers(pa.array([t]))))
        z = model.bias + model.per_word * len(t.split()) + sum(weight.get(h, 0.0) for _, hs in found for h in hs.tolist())
        assert abs(1 / (1 + np.exp(-z)) - model(pa.array([t]))[0]) < 1e-9


def test_sample_is_bounded(spark):
    """Repeated rows of a document, and repeated labels, bring it to the driver once; ties are drawn by hash."""
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, int(i % 20 < 10), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    texts, y, weight, _ = toxicity.sampled(docs, labels, "quality", 4)
    assert len(texts) == len(y) == 8 and y.sum() == 4 and weight.tolist() == [2.5] * 8


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    votes = np.stack([rng.random(2000) < np.where(truth, 0.6, 0.02) for _ in range(8)] + [rng.random(2000) < 0.1], 1)
    given = np.where(rng.random(2000) < 0.1, ~truth, truth).astype(int)
    q = toxicity.label_model(votes, given, 0.2)
    missed = truth & (given == 0) & (votes[:, :8].sum(1) >= 3)
    assert missed.sum() > 20
    assert np.mean(q[missed] > 0.5) > 0.9
    assert np.mean((q > 0.5) == truth) > np.mean(given == truth)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_odd_rows(spark, odd, empty, frames, run):
    docs, labels, _ = frames
    assert run(spark, odd, labels).count() == 6
    got = run(spark, docs.union(odd.select(*docs.columns)), labels).filter("doc_id is null").collect()
    assert [r["held_out"] for r in got] == [False, False]
    assert run(spark, empty, labels).count() == 0
    none = labels.limit(0)
    assert {0 <= r["score"] <= 1 for r in run(spark, odd, none).collect()} == {True}


def test_accepted_keeps_all_columns(spark, odd, frames):
    docs, labels, truth = frames
    kept = {r["doc_id"] for r in quality.accepted(spark, docs, labels).collect()}
    good = {d for d, (q, _) in truth.items() if q}
    assert len(good - kept) <= 0.02 * len(good)
    assert len(kept - good) <= 0.15 * (len(truth) - len(good))
    assert quality.accepted(spark, odd, labels).columns == odd.columns
