"""Alignment of two tokenizers' tokens over the same bytes.

Side A encodes a space and the text by byte-level BPE, side B the text by SentencePiece, which puts the space itself;
special tokens' strings are ordinary text on both sides.  Per batch, the texts' bytes stand one behind another, so an
offset names its document too, and two ``pandas.merge_asof`` give every token's start the other side's covering token:

* the union of both directions is all overlapping pairs,
* the pairs among them that end together cut both sides into groups, and are the links.

Documents longer than ``CHARS`` are aligned in segments cut where both sides have a token's edge.

Links are counted over the whole corpus.  Linked tokens end together, so one's bytes end with the other's: there are at
most as many linked id pairs as the two vocabularies have bytes, and that table is sent to all tasks.

Cases: a null or empty text, and one whose tokens of either side do not give back its bytes, has no tokens: zeros and an
empty digest.  Null or repeated doc_ids and repeated rows are aligned row by row; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import chunks, common

COUNTS = ["n_a", "n_b", "n_groups", "n_overlaps"]
LINK = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
SCHEMA = "n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups_sha256 string, links array<struct<a:int,b:int,n:bigint>>"


class Side(NamedTuple):
    """Tokens of a batch: ids, and where each begins and ends among the batch's bytes."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Aligned(NamedTuple):
    """``owner_a`` and ``owner_b`` give each token's segment; ``overlaps`` is (a, b) token places, ``link`` says which of
    them end together, in order."""

    a: Side
    b: Side
    owner_a: np.ndarray
    owner_b: np.ndarray
    overlaps: np.ndarray
    link: np.ndarray
    ok: np.ndarray


class Vocabulary:
    """Bytes and decimal names of all ids of one side."""

    def __init__(self, token_bytes: list[bytes]):
        self.size = np.array([len(b) for b in token_bytes], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return chunks.gathered(self.bytes, self.first[ids], self.size[ids])


class Aligner:
    """Both encoders of a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = chunks.byte_level(a_path, lead=True, literal=True), chunks.pieces(b_path)
        self.va, self.vb = Vocabulary(self.a.token_bytes), Vocabulary(self.b.token_bytes)
        count = max(len(self.va.size), len(self.vb.size))
        # ids followed by a comma, by the mark between the sides, by the mark between groups
        self.names = pa.array([f"{k}{mark}" for mark in ",|;" for k in range(count)], pa.large_string())
        self.count = count

    def align(self, texts: list[str]) -> Aligned:
        """Tokens of the texts that both sides give back byte by byte (``ok``), and their overlaps."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        given = [b" " + t.encode() for t in texts]
        size = np.array([len(g) for g in given], np.int64)
        ok = size > 1
        for ids, known in ((ids_a, self.va), (ids_b, self.vb)):
            ends = np.concatenate(([0], np.cumsum(known.size[ids.ids])))
            ok &= np.diff(ends[ids.starts]) == size
        bytes_given = np.frombuffer(b"".join([g for g, good in zip(given, ok) if good]), np.uint8)
        first = np.cumsum(size[ok]) - size[ok]
        same = np.ones(int(ok.sum()), bool)
        for ids, known in ((ids_a, self.va), (ids_b, self.vb)):
            differ = known.joined(ids.ids[np.repeat(ok, np.diff(ids.starts))]) != bytes_given
            if differ.any():
                same &= ~np.logical_or.reduceat(differ, first)
        ok[np.nonzero(ok)[0][~same]] = False

        def side(ids: chunks.Ids, known: Vocabulary) -> tuple[Side, np.ndarray]:
            owner = np.repeat(np.arange(len(texts)), np.diff(ids.starts))
            kept = ids.ids[ok[owner]]
            end = np.cumsum(known.size[kept])
            return Side(kept, end - known.size[kept], end), owner[ok[owner]]

        (a, owner_a), (b, owner_b) = side(ids_a, self.va), side(ids_b, self.vb)
        overlaps = covering(a, b)
        return Aligned(a, b, owner_a, owner_b, overlaps, a.end[overlaps[:, 0]] == b.end[overlaps[:, 1]], ok)

    def texts(self, al: Aligned, a_end: np.ndarray, b_end: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """All groups as ``a1,a2|b1;`` in order: bytes, and the place behind each B token's group mark."""
        last_a, last_b = np.zeros(len(al.a.ids), bool), np.zeros(len(al.b.ids), bool)
        last_a[a_end], last_b[b_end] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        name = np.empty(len(al.a.ids) + len(al.b.ids), np.int64)
        first_b = np.concatenate(([0], b_end[:-1] + 1)) if len(b_end) else np.zeros(0, np.int64)
        at_b = np.arange(len(al.b.ids)) + a_end[group_b] + 1
        name[np.arange(len(al.a.ids)) + first_b[group_a]] = al.a.ids + self.count * last_a
        name[at_b] = al.b.ids + 2 * self.count * last_b
        shown = self.names.take(pa.array(name))
        offsets = np.frombuffer(shown.buffers()[1], np.int64, len(shown) + 1)
        data = shown.buffers()[2]
        return memoryview(data) if data is not None else memoryview(b""), offsets[at_b[b_end] + 1]


def covering(a: Side, b: Side) -> np.ndarray:
    """All overlapping (a, b) token places in order: each start with the token of the other side that covers it."""
    left = pd.DataFrame({"at": a.start, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "b": np.arange(len(b.ids))})
    to_b = pd.merge_asof(left, right, on="at")
    to_a = pd.merge_asof(right, left, on="at")
    # tokens that start together are found from both sides
    to_a = to_a[a.start[to_a["a"].to_numpy()] != to_a["at"].to_numpy()] if len(to_a) else to_a
    pairs = np.concatenate((to_b[["a", "b"]].to_numpy(np.int64), to_a[["a", "b"]].to_numpy(np.int64)))
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or chunks.path_of("byte_bpe_50k.json"), b_path or chunks.path_of("piece_bpe_32k.model")


def summarise(texts: list[str | None], al: Aligner) -> pa.RecordBatch:
    """Counts, digest and counted links of each text."""
    n, wide = len(texts), al.count
    counts, digest, ok = np.zeros((4, n), np.int64), [hashlib.sha256() for _ in texts], np.ones(n, bool)
    begun = [False] * n
    keys, weights = [], []
    for owners, parts in chunks.batches(texts):
        owner = np.array(owners)
        x = al.align(parts)
        ok[owner[~x.ok]] = False
        a_end, b_end = x.overlaps[x.link, 0], x.overlaps[x.link, 1]
        doc_a, doc_b = owner[x.owner_a], owner[x.owner_b]
        for k, docs in enumerate((doc_a, doc_b, doc_a[a_end], doc_a[x.overlaps[:, 0]])):
            counts[k] += np.bincount(docs, minlength=n)
        if len(a_end):
            data, behind = al.texts(x, a_end, b_end)
            per = np.bincount(doc_b[b_end], minlength=n)
            last = np.cumsum(per) - 1
            at = 0
            for doc in np.nonzero(per)[0].tolist():
                end = int(behind[last[doc]])
                if begun[doc]:
                    digest[doc].update(b";")
                digest[doc].update(data[at:end - 1])
                begun[doc], at = True, end
        found, times = np.unique((doc_a[a_end] * wide + x.a.ids[a_end].astype(np.int64)) * wide + x.b.ids[b_end], return_counts=True)
        keys.append(found)
        weights.append(times)
    key, place = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    times = np.bincount(place, np.concatenate(weights), len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    doc, pair = np.divmod(key, wide * wide)
    counts[:, ~ok] = 0
    kept = ok[doc]
    doc, pair, times = doc[kept], pair[kept], times[kept]
    links = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(pair // wide, pa.int32()), pa.array(pair % wide, pa.int32()), pa.array(times, pa.int64())], names=["a", "b", "n"]))
    shown = [d.hexdigest() if good and c else "" for d, good, c in zip(digest, ok.tolist(), counts[2].tolist())]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in counts), pa.array(shown, pa.string()), links], names=[*COUNTS, "groups_sha256", "links"])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, token, group and overlap counts, the groups' digest, and its counted links."""
    common.small_batches(docs.sparkSession)
    where = paths(a_path, b_path)

    def work(batches):
        for b in batches:
            found = summarise(b.column(1).to_pylist(), aligner(*where))
            yield pa.RecordBatch.from_arrays([b.column(0), *found.columns], names=["doc_id", *found.schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, {SCHEMA}")


def tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself: (doc_id, grp, start, end, a_ids, b_ids), one row per group, with its byte range in space+text."""
    common.small_batches(docs.sparkSession)
    where = paths(a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in batches:
            al = aligner(*where)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(texts), 64):
                part = texts[lo:lo + 64]
                x = al.align(part)
                a_end, b_end = x.overlaps[x.link, 0], x.overlaps[x.link, 1]
                doc = x.owner_a[a_end]
                per = np.bincount(doc, minlength=len(part))
                end = x.a.end[a_end]
                start = np.concatenate(([0], end[:-1])) if len(end) else end
                opened = np.concatenate(([0], np.cumsum(per)))[:-1][doc] if len(doc) else doc
                base = start[opened] if len(doc) else start
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last + 1)), pa.int32()), pa.array(side.ids.astype(np.int32)))
                    for side, last in ((x.a, a_end), (x.b, b_end))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc + lo)), pa.array(np.arange(len(doc)) - opened, pa.int64()), pa.array(start - base, pa.int64()),
                     pa.array(end - base, pa.int64()), *lists], names=["doc_id", "grp", "start", "end", "a_ids", "b_ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        work, f"doc_id {kind}, grp bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold a pair of ids."""
    return aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("n"))


def scored(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Adds n_links, n_best (links whose pair is the corpus' most frequent of their B id) and count_sum."""
    where = paths(a_path, b_path)
    spark = aligned.sparkSession
    bound = sum(int(v.size.sum()) for v in (aligner(*where).va, aligner(*where).vb))
    table = link_counts(aligned).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} linked id pairs: the vocabularies allow {bound}")
    a, b, n = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.lexsort((a, b))
    a, b, n = a[order], b[order], n[order]
    first = np.nonzero(np.diff(b, prepend=-1))[0]
    top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(b)))) if len(b) else n
    sent = spark.sparkContext.broadcast((b << 32 | a, n, n == top))

    def work(batches):
        key, count, best = sent.value
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            flat = links.flatten()
            pair = flat.field("b").to_numpy().astype(np.int64) << 32 | flat.field("a").to_numpy()
            times = flat.field("n").to_numpy()
            place = np.searchsorted(key, pair)
            ends = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))))
            sums = []
            for values in (times, times * best[place], times * count[place]):
                total = np.concatenate(([0], np.cumsum(values)))
                sums.append(pa.array(np.diff(total[ends]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), *sums],
                names=[*batch.schema.names[:-1], "n_links", "n_best", "count_sum"])

    kept = [c for c in aligned.columns if c != "links"]
    fields = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return aligned.select(*kept, "links").mapInArrow(work, f"{fields}, n_links bigint, n_best bigint, count_sum bigint")


@common.query("op12_align")
def op12(spark, sf_dir):
    aligned = common.stored(align(common.table(spark, sf_dir, "documents")), "aligned")
    return scored(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
