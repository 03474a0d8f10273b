"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: ``A-Z`` in the whole text lower-cased, words are runs of bytes other than space and 0x09-0x0D, shingles are
``width`` words joined by one space, repeats included (fewer words: all of them; no word or a null text: fingerprint 0,
compared like any other).  A bit is 1 if it is set in more than half of the shingles' XXH64 values (seed 42).

Search: equal fingerprints become one row.  A tile holds fingerprints with the same population counts in four 16-bit
lanes, at most ``tile`` of them.  Two fingerprints that differ in r bits differ by at most r in the sum of the four count
differences, so tile pairs further apart are skipped, the others compared in full with exclusive-or and bit counts.  A
tile pair hands on a spanning forest of its links, never all of them.  Components of the links are the groups.

Cases: repeated rows and null ids keep their rows; an empty table gives an empty table; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import common

SEED = 42
LANES = 4
ROWS = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row."""
    common.small_batches(docs.sparkSession)

    @common.tidy
    def work(batches):
        for b in batches:
            out = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, fp bigint")


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one tile pair, reduced to a star per connected group."""
    nodes = left if same else np.concatenate((left, right))
    shift = 0 if same else len(left)
    ones, twos = [], []
    for at in range(0, len(left), ROWS):
        near = np.bitwise_count(left[at:at + ROWS, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        ones.append(i + at)
        twos.append(j + shift)
    i, j = np.concatenate(ones), np.concatenate(twos)
    keep = i != j
    i, j = i[keep], j[keep]
    if not len(i):
        return nodes[:0], nodes[:0]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(prints: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` that connect all those within ``radius`` bits."""
    lane = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) for i in range(LANES)]
    sums = prints.select("fp", *[c.cast("int").alias(f"p{i}") for i, c in enumerate(lane)])
    names = [f"p{i}" for i in range(LANES)]
    # the number of signatures is bounded (17 per lane); their counts only say into how many tiles each is cut
    cuts = sums.groupBy(names).agg(F.ceil(F.count("*") / tile).alias("cuts"))
    tiles = (
        sums.join(F.broadcast(cuts), names)
        .withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        .groupBy(*names, "cut").agg(F.collect_list("fp").alias("fps")))
    tiles = common.stored(tiles, "tiles")
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, s)) <= radius and s >= (0,) * LANES]
    moves = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])).alias("s")
    left = tiles.select(F.col("fps").alias("l"), F.col("cut").alias("lcut"), *names, moves)
    left = left.select("l", "lcut", *[(F.col(n) + F.col("s")[i]).alias(n) for i, n in enumerate(names)], F.expr(f"forall(s, x -> x = 0)").alias("same"))
    pairs = (
        left.join(tiles.select(F.col("fps").alias("r"), F.col("cut").alias("rcut"), *names), names)
        .where(~F.col("same") | (F.col("lcut") <= F.col("rcut")))
        .select("l", "r", (F.col("same") & (F.col("lcut") == F.col("rcut"))).alias("one")))

    def work(batches):
        for b in batches:
            for l, r, one in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                x, y = (np.asarray(v.values).view("<u8") for v in (l, r))
                u, v = _forest(x, y, one, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view("<i8")), pa.array(v.view("<i8"))], names=["a", "b"])

    return pairs.mapInArrow(work, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, tile: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id, copies, component_prints) for every row of ``docs``."""
    rows = common.stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    prints = common.stored(prints, "prints")
    found = common.components(links(prints, radius, tile))
    member = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("component_prints"))
    return (
        rows.join(member.join(heads, "root").select("fp", "component_id", "copies", "component_prints"), "fp")
        .select("doc_id", "fp", "component_id", "copies", "component_prints"))


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Rows of ``docs`` that stay: the one with the smallest doc_id of each group, once if its row is repeated.

    All columns of ``docs`` pass through, whatever their names.
    """
    head = common.fresh(docs, "head")
    found = groups(docs, width=width, radius=radius)
    heads = found.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    heads = common.stored(heads, "heads")
    once = heads.where("rows = 1").select(F.col("doc_id").alias(head))
    more = heads.where("rows > 1").select(F.col("doc_id").alias(head))
    same = F.col("doc_id").eqNullSafe(F.col(head))
    return docs.join(once, same, "left_semi").unionByName(docs.join(more, same, "left_semi").dropDuplicates(["doc_id"]))


@common.query("op1_simhash")
def op1(spark, sf_dir):
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")
