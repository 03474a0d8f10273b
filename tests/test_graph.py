"""Tracing against a queue in plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from riskspark.operators import dataflow


def queue_trails(edges, sources, sinks):
    out = {}
    for s in sources:
        waiting, visited = deque([[s]]), {s}
        while waiting:
            path = waiting.popleft()
            if path[-1] in sinks and path[-1] != s:
                out[s] = path
                break
            for _, dst in sorted((q, d) for a, d, q in edges if a == path[-1]):
                if dst not in visited:
                    visited.add(dst)
                    waiting.append([*path, dst])
    return out


@pytest.mark.parametrize("seed,nodes,links", [(1, 12, 20), (2, 40, 60), (3, 30, 120), (4, 25, 25)])
def test_trails_are_those_of_a_queue(spark, seed, nodes, links):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), q) for q in range(links)]
    edges += [(k, k + 1, 1000 + k) for k in range(0, 9)]  # a chain
    sinks, sources = set(rng.sample(range(nodes), 3)), rng.sample(range(nodes), 8)
    e = spark.createDataFrame([("g", *x) for x in edges], "g string, src long, dst long, seq long")
    node = lambda xs: spark.createDataFrame([("g", x) for x in xs], "g string, node long")
    found = dataflow.trace_to_sink(e, node(sources), node(sinks), ["g"]).collect()
    want = queue_trails(edges, sources, sinks)
    assert {r.source: r.trail for r in found} == want
    assert all(r.sink == r.trail[-1] and r.depth == len(r.trail) - 1 for r in found) and len(found) == len(want)


def test_long_chain_and_none(spark):
    e = spark.range(30).select(F.lit("g").alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).cast("long").alias("seq"))
    node = lambda x: spark.createDataFrame([("g", x)], "g string, node long")
    assert [r.trail for r in dataflow.trace_to_sink(e, node(0), node(20), ["g"]).collect()] == [list(range(21))]
    assert dataflow.trace_to_sink(e, node(5), node(2), ["g"]).count() == 0 and dataflow.trace_to_sink(e.limit(0), node(0), node(1), ["g"]).count() == 0
