"""Sliced operators against plain loops, with one key holding most rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskspark.operators import ordered

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _events(seed, n=1500, span=20000):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(8)}", BASE + timedelta(seconds=rng.randrange(span), microseconds=rng.choice([0, 5]))) for i in range(n)]
    return rows


def _by_key(rows):
    out = defaultdict(list)
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        out[k].append((i, t))
    return out


@pytest.mark.parametrize("seed,span", [(1, 20000), (2, 800), (3, 4_000_000)])
def test_cooldown_and_rate_limit(spark, seed, span):
    rows = _events(seed, span=span)
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp")
    emitted = {r.event_id: r.emitted for r in ordered.cooldown(df, ["key"], seconds=60).collect()}
    status = {r.event_id: (r.status, r.retry_after) for r in ordered.rate_limit(df, ["key"], limit=3, seconds=60).collect()}
    for items in _by_key(rows).values():
        last, count, reset = None, 0, None
        for i, t in items:
            fire = last is None or (t - last).total_seconds() >= 60
            if fire:
                last = t
            assert emitted[i] == fire
            if reset is None or reset <= t:
                count, reset = 1, t + timedelta(seconds=60)
                assert status[i] == (200, None)
            elif count >= 3:
                left = (reset - t) / timedelta(microseconds=1)
                assert status[i] == (429, max(1, -(-int(left) // 1_000_000)))
            else:
                count += 1
                assert status[i] == (200, None)


def test_sessions_and_running_sums(spark):
    rows = _events(4, span=3_000_000)
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp")
    got = {(r.key, r.session): r.events for r in ordered.debounce(df, ["key"], path="key", gap_seconds=3600).collect()}
    sums = {r.event_id: r.s for r in ordered.prior_sum(df, ["key"], "ts", "event_id", F.lit(1), "s").collect()}
    want = defaultdict(int)
    for k, items in _by_key(rows).items():
        n, prev = 0, None
        for pos, (i, t) in enumerate(items):
            assert sums[i] == pos
            n += prev is None or (t - prev).total_seconds() >= 3600
            prev = t
            want[(k, n)] += 1
    assert got == dict(want)


def test_prefix_by_range(spark):
    rows = [(k, i, (i * 7) % 11) for k, n in (("hot", 900), ("a", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i int, v int")
    got = {(r.key, r.i): r.p for r in ordered.prefix_by_range(df, ["key"], ["i"], F.col("v"), "p").collect()}
    run = defaultdict(int)
    for k, i, v in rows:
        assert got[(k, i)] == run[k]
        run[k] += v


def test_credit_ledger_clamps(spark):
    rng = random.Random(5)
    rows = [(i, "u", BASE + timedelta(hours=i * 3), rng.choice([-1, -1, -1, 0, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp, d int")
    got = {r.event_id: r.balance_before for r in ordered.credit_ledger(df, ["key"], F.col("d"), 2).collect()}
    b = 2
    for i, _, _, d in rows:
        assert got[i] == b
        b = max(b + d, 0)


def test_one_key_within_a_minute_is_dealt_evenly(spark):
    from riskspark.operators import ordered

    n = 20000
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(99).alias("key"), (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("id") % 60).cast("timestamp").alias("ts"))
    parts = [r["count"] for r in ordered.by_range(df, ["key"], ["ts", "id"]).groupBy("_p").count().collect()]
    assert max(parts) < 2 * n / len(parts)
    sums = ordered.prior_sum(df, ["key"], "ts", "id", F.lit(1), "s").where("key = 99").agg(F.max("s"), F.countDistinct("s")).first()
    assert tuple(sums) == (n * 19 // 20 - 1, n * 19 // 20)
    prev = ordered.prior_ts(df, ["key"], "ts", "id", "p")
    assert prev.where("p is null").count() == 8 and prev.where("p > ts").count() == 0
