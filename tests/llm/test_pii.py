"""Personal data: base spans by plain Python, what the method adds, odd input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskspark.llm import pii

SCHEMA = "doc_id long, text string, found string, base int, kind int, votes string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c_x@y.zz .@d.e é😀 u@v.w", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111x",
    "4111111111111111", "+1 (269) 555-3296 4524132264652876", "+1 (((( ) 2", "++1 234 567 8901..", "phone: (415) 555-1234, mail bob [at] mail [dot] com",
    "1" * 3000, "a" * 200_000, "1 " * 60_000, "a." * 50_000 + "@b", "x@" + "y." * 30_000 + "z", "2001:0db8:0000:0000:0000:ff00:0042:8329", "٣٤٥ 5",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")),
                  "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}
            if ok[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    return docs + [(5000 + i, t) for i, t in enumerate(ODD)] + [(6000, None), (None, ""), (7, "me@x.org"), (7, "me@x.org")]


@pytest.fixture(scope="module")
def spans(spark, rows):
    df = spark.createDataFrame([(*r, "f", 1, 2, "v") for r in rows], SCHEMA)
    found = pii.candidates(df).cache()
    return pii.decide(found, pii.fit(found)).select(
        "doc_id", pii.span_text(F.col("base")).alias("base"), pii.span_text(F.col("added")).alias("added")).collect()


def test_base_spans(rows, spans):
    want = sorted(((d, ",".join(plain_spans(t))) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.base) for r in spans), key=repr) == want
    assert sum(bool(b) for _, b in want) > 25


def test_query_counts_by_kind(spark, tmp_path):
    rows = [(1, "a@b.c 1.2.3.4 5.6.7.8"), (2, "4111 1111 1111 1111"), (3, "+1 269 555 3296, x@y.zz"), (4, "nothing"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.op5(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2, 0, 0), 2: (0, 0, 1, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}


def test_added_spans(rows, spans):
    added = {r.doc_id: r.added for r in spans if r.added}
    assert added[5006] == "card:18:34,phone:0:17"
    assert "phone:7:21" in added[5009] and "email:28:51" in added[5009]
    texts = dict(rows)
    assert not any(d is not None and d < 5000 and not re.search(r"\d{4}", texts[d]) for d in added)


def test_digest_of_no_span(spark):
    df = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    found = pii.candidates(df)
    r = pii.decide(found, pii.fit(found)).select(F.sha2(pii.span_text(F.col("base")), 256).alias("h"), "added").first()
    assert r.h == hashlib.sha256(b"").hexdigest() and r.added == []


def test_reliabilities_find_the_good_labeler():
    # labelers 0-2 agree with the truth, 3 is silent, 4 is a coin
    counts = [(2, (y, y, y, 0, c), 50) for y in (-1, 1) for c in (-1, 1)] + [(2, (1, -1, -1, 0, 1), 3), (2, (-1, 1, 1, 0, -1), 3)]
    prior, says, post = pii.reliabilities(counts)
    assert says[0][1, 1] > 0.9 and abs(says[4][1, 1] - 0.5) < 0.1
    weights = pii.train(counts, post)
    assert sum(w * x for w, x in zip(weights, pii._features(2, (1, 1, 1, 0, -1)))) > 0 > sum(w * x for w, x in zip(weights, pii._features(2, (-1, -1, -1, 0, 1))))


def test_empty(spark):
    none = pii.candidates(spark.createDataFrame([], SCHEMA))
    assert pii.decide(none, pii.fit(none)).count() == 0
