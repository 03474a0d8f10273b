"""SimHash groups against a brute-force version, and odd input."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import common, simhash

SCHEMA = "doc_id long, text string, fp string, component_id long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """{row number: smallest doc_id reachable}"""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def result(df):
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = " ".join(f"w{i}" for i in range(400))
    extra = [(9000 + i, base + f" tail{i}") for i in range(40)] + [(9100 + i, f"{base} tail{i} other{i}") for i in range(20)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    got = result(simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=16))
    assert got == sorted(plain_groups(rows), key=repr)
    assert sum(c != d for d, _, c in got) > 20


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (4, " \n\t"), (7, "one"), (8, "One"), (9, "a b"), (9, "a b"), (None, "a b"), (10, "\x85x"),
            (11, "long " * 50000), (12, "long " * 50001), (13, "ünï çödé ÀB")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    assert result(simhash.groups(df)) == sorted(plain_groups(rows), key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9, 10, 11, 13]


def test_empty(spark):
    assert simhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long")).collect()}
    assert {got[i] for i in range(1, 201)} == {1}
    assert {got[1000 + i] for i in range(300)} == {1000}


def test_forest_keeps_groups_together():
    near = np.array([0, 1, 3, 7, 15, 7 << 40, 7 << 50], "<u8")
    u, v = simhash._forest(near, near, True, 1)
    assert set(u.tolist()) == {1, 3, 7, 15} and set(v.tolist()) == {0}
