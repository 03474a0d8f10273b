"""Quality and toxicity: held-out accuracy, exactness of the nearest neighbours, odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import learning, queries, toxicity, zquality

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, vector int, label int, toxic string"
ODD = [(1, None), (2, ""), (3, "\n"), (4, "word " * 40000), (5, "é漢字😀"), (6, "a"), (6, "a"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "t") for r in rows], SCHEMA)


@pytest.mark.parametrize("name,label,folds,held", [("op6_zquality", "quality", 4, 2), ("op8_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, folds, held):
    rows = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = [r for r in rows if r.held_out and r[label] is not None]
    recall = {y: np.mean([r.predicted == y for r in known if r[label] == y]) for y in (0, 1)}
    assert recall[0] > 0.95 and recall[1] > 0.88


def test_scores_do_not_see_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = learning.fold(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (zquality.fit(docs, x, ~held) for x in (labels, turned))
    assert (a.good, a.bad, a.intercept, a.slope) == (b.good, b.bad, b.intercept, b.slope)


def test_long_texts_score_as_their_parts_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = learning.fold(F.col("doc_id"), 4) == 2
    model = zquality.fit(docs, labels, ~held)
    rows = docs.join(labels.where(held), "doc_id").where("length(text) between 1500 and 6000").orderBy("doc_id").limit(200).collect()
    once, often = (model.scores([r.text * k for r in rows]) for k in (1, 20))
    good, sure = np.array([r.quality == 1 for r in rows]), np.abs(once - 0.7) > 0.2
    assert good.sum() > 30 and (often[good & sure] >= 0.7).mean() > 0.97 and ((often >= 0.7) == (once >= 0.7))[sure].mean() > 0.97
    long = model.scores([r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 10000").collect()])
    assert len(long) > 50 and (long >= 0.7).mean() > 0.97


def brute_nearest(vectors, query, k, but):
    scores = [(-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors) if i != but]
    return [(i, -c) for c, i in sorted(s for s in scores if s[0] < 0)[:k]]


def test_block_max_index_is_exact():
    rng = random.Random(4)

    def vector():
        v = {rng.randint(0, 40): rng.random() for _ in range(rng.randint(1, 6))}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    vectors = [vector() for _ in range(700)] + [{3: 1.0}] * 200
    index = toxicity.BlockMaxIndex(vectors, 41)
    for q in range(120):
        who, near = index.nearest(vectors[q] if q % 2 else vector(), 15, q if q % 2 else -1)
        want = brute_nearest(vectors, vectors[q], 15, q) if q % 2 else None
        if want:
            assert who == [i for i, _ in want] and np.allclose(near, [c for _, c in want])
    assert index.nearest({99: 1.0}, 5) == ([], [])


def test_odd_rows(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(500)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(60)) + (" vile" * 2 if i % 2 else "") if i % 4 > 1 else "junk *** junk *** " * 30 + ("vile" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame(
        [(100 + i, int(i % 4 > 1), i % 2) for i in range(200)] + [(100, 1, 0), (None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + ODD)
    model = zquality.fit(docs, labels)
    got = zquality.score(docs, model).collect()
    assert len(got) == 208 and all(0 <= r.score <= 1 for r in got)
    tox, found = toxicity.fit(docs, labels)
    scored = toxicity.score(found, tox).collect()
    assert len(scored) == 208
    assert {r.doc_id: r.score >= 0.7 for r in scored if r.doc_id and r.doc_id >= 100} == {100 + i: bool(i % 2) for i in range(200)}
    assert all(r.evidence and all(e.label == 1 for e in r.evidence) for r in scored if r.score >= 0.7)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 0, 0), (2, 0, 0)]])
def test_labels_of_one_class_or_none(spark, labels):
    docs = frame(spark, ODD)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    share = 1.0 if not labels or labels[0][1] else 0.0
    assert {r.score for r in zquality.score(docs, zquality.fit(docs, known)).collect()} == {share}
    tox, found = toxicity.fit(docs, known)
    assert {r.score for r in toxicity.score(found, tox).collect()} == {float(bool(labels) and labels[0][2])}


def test_empty(spark):
    none, labels = frame(spark, []), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert zquality.score(none, zquality.fit(none, labels)).count() == 0
    tox, found = toxicity.fit(none, labels)
    assert toxicity.score(found, tox).count() == 0
