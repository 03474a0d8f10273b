"""Decontamination: recall against brute force, paraphrases, odd input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from riskspark.llm import decontam

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=60))
@settings(max_examples=200, deadline=None)
def test_subsequence(a, b):
    assert decontam.subsequence(a, b) == plain_lcs(a, b)


def changed(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"zz{rng.randint(0, 999)}"
    return " ".join(words)


def test_recall_and_clean_documents(spark):
    rng = random.Random(7)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(t.lower().split())
    planted = {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}
    clean = [t for d, t in docs if not any(p[0] == d for p in planted)]
    extra = []
    for k, (i, x) in enumerate(items):
        host = clean[(7 * k) % len(clean)].split()
        at = rng.randint(0, len(host))
        extra.append((10_000 + k, " ".join(host[:at] + changed(rng, x, 0.15).split() + host[at:])))
        planted.add((10_000 + k, i))
    df = spark.createDataFrame([(*r, 0.1, "x") for r in docs + extra], "doc_id long, text string, cosine double, item_id string")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert len(got & planted) >= 0.97 * len(planted)
    assert len({d for d, _ in got} - {d for d, _ in planted}) <= 2


def test_recall_by_item_length_on_a_large_benchmark(spark):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text]
    long = [t.split() for t in texts if len(t.split()) > 80]
    # items are stretches of one half of the documents, planted in the other
    items = []
    for k in range(640):
        own, size = long[2 * (k % (len(long) // 2))], (12, 16, 20, 40)[k % 4]
        at = rng.randint(0, len(own) - size)
        items.append((k, " ".join(own[at:at + size])))
    rows, sizes = [], {}
    for k, x in items:
        host = long[2 * rng.randrange(len(long) // 2) + 1]
        at = rng.randint(0, len(host))
        rows.append((10_000 + k, " ".join(host[:at] + changed(rng, x, 0.15).split() + host[at:])))
        sizes[k] = len(x.split())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {n: np.mean([(10_000 + k, k) in got for k in sizes if sizes[k] == n]) for n in (12, 16, 20, 40)}
    assert recall[12] >= 0.96 and min(recall[16], recall[20], recall[40]) >= 0.98, recall


def test_latent_directions_match_an_exact_decomposition(spark):
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[20 * (k % 3):20 * (k % 3) + 20], 30)) for k in range(60)]
    idf = np.ones(decontam.FEATURES)
    rows = spark.createDataFrame([(t, None) for t in texts], "text string, most int")
    found = decontam.latent(rows, idf, rank=3)
    a = np.zeros((60, decontam.FEATURES))
    for k, t in enumerate(texts):
        for p in decontam.passages(decontam.columns_of(t)):
            at, n = np.unique(p, return_counts=True)
            a[k, at] += np.minimum(n, 2)
        a[k] /= np.linalg.norm(a[k])
    _, s, v = np.linalg.svd(a, full_matrices=False)
    exact = v[:3] / s[:3, None]
    assert np.allclose(np.abs(exact @ found / np.linalg.norm(exact, axis=1)[:, None] / np.linalg.norm(found, axis=0)), np.eye(3), atol=0.02)


def test_odd_rows(spark):
    item = "the quick brown fox jumps over one lazy dog. It was named rex by its owner in town"
    long = "filler " * 150_000 + item + " filler" * 500
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, f"x {item}"), (4, long), (5, "rex"), (6, "!!! ... ?")]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, overlap string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item.upper())], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in (3, 4, None) for i in (1, 4)], key=repr)


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    items = [(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(5)]
    docs = spark.createDataFrame([(10 + i, f"start {t} end") for i, t in items], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(10 + i, i) for i in range(5)]


def test_empty(spark):
    docs, items = (spark.createDataFrame([], f"{n} long, text string") for n in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontam.contaminated(docs, items).count() == 0
    assert decontam.contaminated(some, items).count() == 0
    assert decontam.contaminated(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_directions_come_from_all_documents(spark):
    """The sums that give the basis hold every passage of every document: plain sums over 6,000 texts, one of them long."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, n)) for n in [*rng.integers(0, 60, 6000), 3000]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    idf, w = rng.random(decontam.FEATURES), rng.standard_normal((decontam.FEATURES, 5))
    gram, cross, n = decontam._documents(decontam.hashed(docs), idf, w)
    want, count = np.zeros((5, 5)), 0
    for t in texts:
        found = decontam.passages(decontam.columns_of(t))
        share = min(1, decontam.EACH / max(1, len(found)))  # a long text weighs no more than a few passages
        for p in found:
            a = np.zeros(decontam.FEATURES)
            for half in (np.unique(p[:decontam.BLOCK]), np.unique(p[decontam.BLOCK:])):
                a[half] += idf[half]
            y = a @ w / np.linalg.norm(a)
            want += share * np.outer(y, y)
            count += share
    assert np.isclose(n, count) and np.allclose(gram, want, rtol=1e-4) and np.allclose(w.T @ cross, want, rtol=1e-4)


def test_plain_words_are_hashed_without_being_remembered():
    """What a worker remembers stays in its memory; only words that Arrow cannot lower-case are kept."""
    texts = ["Hello, WORLD! ... hello --- (x)", "", None, " \n", "«Ünï» İstanbul ΌΣ. Y…", "a\x00b C!"]
    known = decontam.Hashes()
    got = decontam.columns(pa.array(texts, pa.string()), known)
    assert [g.tolist() for g in got] == [decontam.columns_of(t).tolist() for t in texts]
    assert set(known) == {"«Ünï»", "İstanbul", "ΌΣ.", "Y…"}


def test_a_task_gives_its_sums_in_parts():
    """A part of the table of all columns stands in a worker a second time, not all of it."""
    class Stop(Exception):
        pass

    class Rows:
        def mapInArrow(self, task, schema):
            self.parts = list(task(iter(())))
            raise Stop

    rows, size = Rows(), 3
    cross = np.arange(decontam.FEATURES * size, dtype=float).reshape(-1, size)
    cross[5] = 0
    with pytest.raises(Stop):
        decontam._summed(rows, size, lambda batches: (np.eye(size), cross, 7.0))
    assert max(b.num_rows for b in rows.parts) <= decontam.GROUP
    whole = pa.Table.from_batches(rows.parts)
    f, values = whole.column("f").to_numpy(), np.stack([whole.column(f"y{i}").to_numpy() for i in range(size)], 1)
    assert sorted(f) == [*range(-size - 1, 0), *(k for k in range(decontam.FEATURES) if k != 5)]
    assert (values[f >= 0] == cross[f[f >= 0]]).all() and values[f == -size - 1].tolist() == [[7.0, 0.0, 0.0]]


def test_the_driver_holds_few_tables_of_all_columns(spark):
    """A table of all columns is 21 MB; while the basis is found, the driver's Python holds no more than a few."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 20_000, 200)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf, words = rng.random(decontam.FEATURES) + 1, decontam.hashed(docs)
    tracemalloc.start()
    try:
        found = decontam.latent(docs.limit(100), idf, words=words)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    table = decontam.FEATURES * (decontam.RANK + decontam.OVER) * 8
    assert found.shape == (decontam.FEATURES, decontam.RANK) and peak < 4.2 * table and kept < table, (kept / table, peak / table)
