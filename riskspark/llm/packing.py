"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document's ids (tokenizers library, no special tokens) end with id ``end_id``.  Only documents longer than ``capacity``
are cut: the first piece takes the remainder, all others are full.  Full pieces are sequences of their own; the rest is
dealt into blocks of ``BLOCK`` pieces, and each block is packed by ``islands`` populations:

* the start is best-fit decreasing and shuffled best-fit packings,
* crossover injects whole well-filled bins of one parent into the other, removes the bins that now hold a document
  twice, and best-fits the displaced documents; mutation empties ill-filled bins and best-fits their documents,
* after an epoch each island hands its best packings to the next island of the block, and evolves on.

Bins below ``settled`` of the capacity are dissolved after the first round and packed again in blocks drawn from many
blocks, so what a block wastes at its end is about one bin in a thousand squared.

Cases: a null text is empty (its end id alone); null or repeated doc_ids and repeated rows are packed row by row; an
empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import chunks, common

BLOCK = 1024
ITEM = "doc_id, piece, start, length, ids_crc32"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    common.small_batches(docs.sparkSession)
    tokenizer = tokenizer or chunks.path_of("byte_bpe_50k.json")
    tail = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    @common.tidy
    def work(batches):
        encoder = chunks.byte_level(tokenizer)
        for b in batches:
            source, piece, start, length, crc = [], [], [], [], []
            found = encoder.encode([t or "" for t in b.column(1).to_pylist()])
            for row in range(b.num_rows):
                ids = memoryview(found.of(row).tobytes() + tail)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    source.append(row)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x:4 * y]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))],
                names=ITEM.split(", "))
            del found
        encoder.forget()

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Packing:
    """Bins of item numbers with their fill."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def insert(self, items: list[int]) -> Packing:
        """Best fit, longest first."""
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill))
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            size = self.lengths[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                self.bins[k].append(i)
                self.fill[k] += size
            else:
                left, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(size)
            insort(room, (left - size, k))
        return self

    def score(self) -> tuple[int, float]:
        """Fewer bins first, then uneven fills."""
        return len(self.bins), -sum(f * f for f in self.fill)

    def keep(self, wanted) -> Packing:
        return Packing([b for k, b in enumerate(self.bins) if wanted(k)], self.lengths, self.capacity)

    def assigned(self) -> list[int]:
        out = [0] * len(self.lengths)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def from_assigned(assigned: list[int], lengths: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, k in enumerate(assigned):
        bins[k].append(i)
    return Packing(bins, lengths, capacity)


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Inject well-filled bins of ``b`` into ``a``."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    best = ranked[:max(1, len(ranked) // 2)]
    injected = [b.bins[k] for k in rng.sample(best, max(1, len(best) // 2))]
    placed = {i for bin_ in injected for i in bin_}
    kept, displaced = [list(x) for x in injected], []
    for bin_ in a.bins:
        if placed.isdisjoint(bin_):
            kept.append(list(bin_))
        else:
            displaced += [i for i in bin_ if i not in placed]
    return Packing(kept, a.lengths, a.capacity).insert(displaced)


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Empty the worst-filled bins and some others, and best-fit what they held."""
    ranked = sorted(range(len(a.bins)), key=lambda k: a.fill[k])
    out = set(ranked[:max(1, len(ranked) // 50)]) | set(rng.sample(ranked, max(1, len(ranked) // 20)))
    left = Packing([list(x) for k, x in enumerate(a.bins) if k not in out], a.lengths, a.capacity)
    return left.insert([i for k in out for i in a.bins[k]])


def evolve(lengths: list[int], start: list[list[int]], capacity: int, seed: int, population: int = 4, generations: int = 16) -> list[list[int]]:
    """One epoch of one island; returns its packings, best first, each as the bin of every item."""
    if not lengths:
        return [[]]
    rng = random.Random(seed)
    pool = [from_assigned(s, lengths, capacity) for s in start]
    if not pool:
        pool = [Packing([], lengths, capacity).insert(list(range(len(lengths))))]
    while len(pool) < population:
        base = pool[0]
        some = set(rng.sample(range(len(base.bins)), len(base.bins) // 2))
        loose = [i for k in some for i in base.bins[k]]
        rng.shuffle(loose)
        mixed = Packing([list(b) for k, b in enumerate(base.bins) if k not in some], lengths, capacity)
        for i in range(0, len(loose), 64):
            mixed.insert(loose[i:i + 64])
        pool.append(mixed)
    pool.sort(key=Packing.score)
    least = math.ceil(sum(lengths) / capacity)
    for _ in range(generations):
        if len(pool[0].bins) <= least:
            break
        a, b = (min(rng.sample(pool, 2), key=Packing.score) for _ in range(2))
        child = mutate(a, rng) if a is b else crossover(a, b, rng)
        if child.score() not in [p.score() for p in pool]:
            pool.append(child)
            pool.sort(key=Packing.score)
            del pool[population:]
    return [p.assigned() for p in pool]


def _epoch(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """rows (block, island, lengths, pool) -> the same with the evolved pool, its bins and its fitness."""
    def work(batches):
        for b in batches:
            pools, bins = [], []
            for block, island, lengths, pool in zip(*(b.column(i).to_pylist() for i in range(4))):
                pools.append(evolve(lengths, pool, capacity, zlib.crc32(f"{block}/{island}/{epoch}".encode())))
                bins.append(from_assigned(pools[-1][0], lengths, capacity).score())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(pools, pa.list_(pa.list_(pa.int32()))),
                 pa.array([x for x, _ in bins], pa.int32()), pa.array([float(y) for _, y in bins])],
                names=["block", "island", "lengths", "pool", "bins", "fitness"])

    return rows.select("block", "island", "lengths", "pool").mapInArrow(
        work, "block bigint, island int, lengths array<int>, pool array<array<int>>, bins int, fitness double")


def _round(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(block, items, best) where best[i] is the bin of items[i]."""
    spark = items.sparkSession
    n = items.count()
    # even blocks at every size: rows are dealt round robin, then cut by their place in the partition
    dealt = items.repartition(max(1, min(round(n / BLOCK), math.ceil(n / (4 * BLOCK)) + 5 if n > BLOCK else 1)))
    blocks = dealt.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).groupBy("block").agg(F.collect_list(F.struct(*ITEM.split(", "))).alias("items"))
    blocks = common.stored(blocks, "blocks")
    tasks = max(1, min(math.ceil(n / BLOCK) * islands, 4 * spark.sparkContext.defaultParallelism))
    rows = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.expr("transform(items, x -> cast(x.length as int))").alias("lengths"),
        F.expr("cast(array() as array<array<int>>)").alias("pool"))
    rows = common.stored(_epoch(rows.repartition(tasks, "block", "island"), capacity, 0), "islands")
    for epoch in range(1, epochs):
        guests = rows.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("pool", 1, 2).alias("guests"))
        rows = rows.join(guests, ["block", "island"]).select("block", "island", "lengths", F.array_distinct(F.concat("guests", "pool")).alias("pool"))
        rows = common.stored(_epoch(rows, capacity, epoch), "islands")
    best = rows.groupBy("block").agg(F.min_by(F.col("pool")[0], F.struct("bins", "fitness", "island")).alias("best"))
    return blocks.join(best, "block")


def pack(found: DataFrame, capacity: int = 2048, islands: int = 2, epochs: int = 2, rounds: int = 2, settled: float = 0.98) -> DataFrame:
    """pieces -> the same rows with sequence_id and offset."""
    found = common.stored(found, "pieces")
    kinds = rounds + 1
    done = [found.where(F.col("length") == capacity).select(
        *ITEM.split(", "), (F.monotonically_increasing_id() * kinds).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    items = found.where(F.col("length") < capacity)
    for k in range(1, rounds + 1):
        bins = _round(items, capacity, islands, epochs).select(
            "block", F.explode(F.arrays_zip("items", "best")).alias("x")).select("block", F.col("x.best").alias("bin"), "x.items.*")
        bins = bins.groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct(*ITEM.split(", ")))).alias("items"), F.sum("length").alias("fill"))
        bins = common.stored(bins, "bins")
        good = bins if k == rounds else bins.where(F.col("fill") >= settled * capacity)
        done.append(good.select(
            F.posexplode("items").alias("at", "x"), ((F.col("block") * BLOCK + F.col("bin")) * kinds + k).alias("sequence_id"),
            F.expr("transform(items, x -> x.length)").alias("sizes")).select(
            "x.*", "sequence_id", F.expr("aggregate(slice(sizes, 1, at), 0L, (s, v) -> s + v)").alias("offset")))
        items = bins.where(F.col("fill") < settled * capacity).select(F.explode("items").alias("x")).select("x.*")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


@common.query("op4_packing")
def op4(spark, sf_dir):
    return pack(pieces(common.table(spark, sf_dir, "documents")))
