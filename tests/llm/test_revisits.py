"""Revisit resolution: SQL twin, plain Python on random records, a hot URL, odd input."""

import random

import duckdb
from pyspark.sql import functions as F

from riskspark.llm import queries, revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, key string, part int, full string, before int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "f", 2) for r in rows], SCHEMA)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    r = con.execute(queries.ORACLES["op3_revisits"])
    cols = [d[0] for d in r.description]
    assert sorted((tuple(x) for x in queries.QUERIES["op3_revisits"](spark, sf).select(cols).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def plain(rows):
    out = {}
    for i, url, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        order = lambda r: (r[2] is not None, r[2] or 0, r[0])
        before = max((r for r in rows if r[3] == "response" and url and r[1] == url and order(r) < (ts is not None, ts or 0, i)), key=order, default=None)
        own, old = headers or {}, (before[4] or {}) if before else {}
        if before is None:
            verdict = "no_response"
        elif "etag" in own and "etag" in old:
            verdict = "resolved" if own["etag"].removeprefix("W/") == old["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in own and "last-modified" in old:
            verdict = "resolved" if own["last-modified"] == old["last-modified"] else "mismatch"
        else:
            verdict = "no_validator"
        merged = old | {k: v for k, v in own.items() if k in revisits.MAY_UPDATE} if verdict == "resolved" else None
        out[i] = (before and before[0], verdict, merged)
    return out


def test_random_records_with_a_hot_url(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        headers = {k: v for k, v in (("etag", f'{rng.choice(["", "W/"])}"{rng.randint(0, 2)}"'), ("last-modified", f"d{rng.randint(0, 1)}"), ("date", str(i)), ("content-type", "t")) if rng.random() < 0.7}
        url = "hot.org/x" if rng.random() < 0.5 else f"h{rng.randint(0, 60)}.org/x"
        rows.append((i, url, rng.choice([None, rng.randint(0, 500)]) if rng.random() < 0.02 else rng.randint(0, 500), rng.choice(["response", "revisit"]), headers or None))
    rows += [(9000, None, 5, "revisit", None), (9001, None, 1, "response", None), (9002, "", 5, "revisit", {}), (9003, "only.org", 1, "revisit", {"etag": "1"})]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = revisits.resolve(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.record_id: (r.response_id, r.verdict, r.headers) for r in found} == plain(rows)


def test_canonical_url(spark):
    pairs = {
        "HTTP://WWW.Site.org:80/A/b/?z=1&utm_source=x&a=2#frag": "site.org/A/b?a=2&z=1", "https://site.org": "site.org", "site.org/?ref=x": "site.org",
        "//": None, "": None, "https://x.org/p?q=%20&&": "x.org/p?q=%20"}
    df = spark.createDataFrame([(u,) for u in pairs], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == pairs


def test_empty(spark):
    assert revisits.resolve(frame(spark, [])).count() == 0
