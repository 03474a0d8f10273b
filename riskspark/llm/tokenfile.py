"""Token files of patched frame-of-reference blocks.

A shard (one binary value) is little-endian:

    header   "PFR1", u32 block length, u64 ids, u32 blocks, u32 documents
    docs     i64 doc_id, u8 1 if it is null, u64 first id's place in the shard, each for all documents
    index    u64 first packed word, u64 first exception, each for all blocks and the end
    blocks   u32 minimum, u8 width, each for all blocks
    packed   u32 words: ids less the block's minimum, their low ``width`` bits, 32 values in ``width`` words
    patches  u16 place in the block, u32 high bits, each for all exceptions

The width of a block is the least that holds the stated share of its ids; the others are exceptions.  One block can be
read alone through the index.  Shards are rows (part, shard, first_id, n_docs, n_ids, payload) of a Parquet table, so
any Hadoop file system holds them and a lost task leaves nothing behind.

Documents are dealt by range of doc_id and sorted within each part, so parts and shards in order are ascending.

Cases: a null text is empty (its end id alone); a null doc_id comes first; repeated rows are all written, ties ordered
by text; an empty table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from riskspark.llm import chunks, common

BLOCK = 1024
SHARD_IDS = 1 << 18
HEAD = struct.Struct("<4sIQII")
SHARE = 0.9


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) values below 2**width -> (rows, BLOCK // 32 * width) words."""
    v = low.reshape(len(low), -1, 32)
    out = np.zeros((len(low), v.shape[1], width), "<u4")
    for k in range(32):
        word, shift = divmod(k * width, 32)
        out[:, :, word] |= v[:, :, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= v[:, :, k] >> np.uint32(32 - shift)
    return out.reshape(len(low), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), -1, width)
    out = np.empty((len(words), w.shape[1], 32), "<u4")
    mask = np.uint32((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        x = w[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | (w[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, k] = x & mask
    return out.reshape(len(words), -1)


def encode_shard(doc_ids: list[int | None], ids: list[bytes], share: float = SHARE) -> bytes:
    """One shard from documents and their ids (little-endian u32 bytes)."""
    values = np.frombuffer(b"".join(ids), "<u4")
    n, blocks = len(values), -(-len(values) // BLOCK)
    padded = np.concatenate((values, np.full(blocks * BLOCK - n, values[-1] if n else 0, "<u4"))).reshape(blocks, BLOCK)
    least = padded.min(axis=1) if blocks else np.zeros(0, "<u4")
    delta = padded - least[:, None]
    need = int(np.ceil(share * BLOCK))
    width = np.zeros(blocks, np.uint8)
    for w in range(32):
        width += (delta < np.uint32(1 << w)).sum(axis=1) < need
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    low = delta & mask.astype("<u4")[:, None]
    high = (delta.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype("<u4")
    row, place = np.nonzero(high)
    words = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 32)))).astype("<u8")
    patches = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=blocks)))).astype("<u8")
    packed = np.zeros(int(words[-1]), "<u4")
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            packed[words[rows].astype(np.int64)[:, None] + np.arange(BLOCK // 32 * int(w))] = _pack(low[rows], int(w))
    sizes = np.array([len(b) // 4 for b in ids], np.int64)
    starts = (np.cumsum(sizes) - sizes).astype("<u8")
    return b"".join((
        HEAD.pack(b"PFR1", BLOCK, n, blocks, len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.tobytes(),
        words.tobytes(), patches.tobytes(), least.astype("<u4").tobytes(), width.tobytes(),
        packed.tobytes(), place.astype("<u2").tobytes(), high[row, place].tobytes()))


class Shard:
    """Reader of one shard."""

    def __init__(self, data: bytes):
        magic, self.block, self.n, self.blocks, docs = HEAD.unpack_from(data)
        if magic != b"PFR1":
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.doc_ids, self.null, self.starts = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.words, self.patches = take("<u8", self.blocks + 1).astype(np.int64), take("<u8", self.blocks + 1).astype(np.int64)
        self.least, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.packed = take("<u4", int(self.words[-1]))
        self.place, self.high = take("<u2", int(self.patches[-1])), take("<u4", int(self.patches[-1]))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks first to last (exclusive); only these are unpacked."""
        last = self.blocks if last is None else last
        width, out = self.width[first:last], np.zeros((last - first, self.block), "<u4")
        for w in np.unique(width):
            if w:
                rows = np.nonzero(width == w)[0]
                at = self.words[first + rows][:, None] + np.arange(self.block // 32 * int(w))
                out[rows] = _unpack(self.packed[at], int(w))
        a, b = self.patches[first], self.patches[last]
        row = np.repeat(np.arange(last - first), np.diff(self.patches[first:last + 1]))
        out[row, self.place[a:b]] |= self.high[a:b] << width[row].astype(np.uint32)
        out += self.least[first:last, None]
        return out.reshape(-1)[:self.n - first * self.block]


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token file and return it as read back."""
    common.small_batches(docs.sparkSession)
    tokenizer = tokenizer or chunks.path_of("byte_bpe_50k.json")
    tail = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def work(batches):
        part, shard = TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0

        def full():
            nonlocal shard, names, held, size
            row = [part, shard, names[0], len(names), size, encode_shard(names, held)]
            shard, names, held, size = shard + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=columns)

        for b in batches:
            found = chunks.byte_level(tokenizer).encode(b.column(1).to_pylist())
            for row, name in enumerate(b.column(0).to_pylist()):
                names.append(name)
                held.append(found.of(row).tobytes() + tail)
                size += len(held[-1]) // 4
                if size >= SHARD_IDS:
                    yield full()
        if names:
            yield full()

    columns = ["part", "shard", "first_id", "n_docs", "n_ids", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    made = rows.mapInArrow(work, "part int, shard int, first_id bigint, n_docs bigint, n_ids bigint, payload binary")
    if path is None:
        return common.stored(made, "token-file")
    made.write.parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of each document, from the shards' bytes.

    Starts are summed in two steps, within a part and over the parts, so that no task sees all shards.
    """
    def work(batches):
        for b in batches:
            for part, shard, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = Shard(payload)
                ids = memoryview(s.ids().tobytes())
                ends = np.append(s.starts[1:], s.n).astype(np.int64)
                starts = s.starts.astype(np.int64)
                crc = [zlib.crc32(ids[4 * a:4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, shard, np.int32)), pa.array(s.doc_ids, mask=s.null.astype(bool)),
                     pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "payload").mapInArrow(work, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("at") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start)"""
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return sizes.withColumn("inside", inside).join(before, "part").select("part", "shard", (F.col("inside") + F.col("before")).alias("shard_start"))


@common.query("op7_tokenfile")
def op7(spark, sf_dir):
    return read_documents(write(common.table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")
