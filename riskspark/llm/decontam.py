"""Benchmark decontamination by latent semantic retrieval.

Words are lower-case, without punctuation at their ends, and hashed to ``FEATURES`` columns.  Inverse document frequencies
count all documents.  Every text is split and hashed once; its columns are stored for the steps below.  Texts are cut into blocks of ``BLOCK`` words; a passage is two neighbouring blocks.

1. Randomised SVD: the passages of all items and of all documents form a TF-IDF matrix A that stays spread over the
   tasks; a document weighs ``EACH`` passages at most and all documents ``SHARE`` passages for one of an item, so that neither a
   long text nor a large corpus hides the others.  A pass computes Y = A W with a thin W and sums Y'Y and Y'A; with Y = QR
   these give Q'A, and its small SVD the latent directions, scaled to unit variance if some are cut off.  The first passes
   read the items and turn a random W to their directions, the last reads all of A.
2. Candidates: every passage of every document against every item passage by cosine in the latent space.  Items of
   ``SHORT`` words or fewer, which are half a passage or less, also meet every single block.  Items come in blocks of
   ``ITEMS``; a block is sent to all tasks, so its size is bounded.
3. Checks: the longest common subsequence of item and surroundings of each candidate, over the item's length, of
   ``copied`` or more is a copy; of ``paraphrased`` or more it is a paraphrase if the answer (the item's last sentence)
   is there too, by the same measure.

Cases: items without a word match nothing; null and empty texts match nothing; repeated rows and null ids are searched row
by row and give one row per (doc_id, item_id), the best; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import common

FEATURES = 1 << 15
BLOCK = 16
SHORT = 24
ITEMS = 5000
RANK, OVER = 64, 16
EACH, SHARE, LEAST = 4, 2, 400
WORDS = 1 << 16
CHARS = 2_000_000
GROUP = 4096
KNOWN = 600_000
SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
END = ".,;:!?\"'()[]{}<>«»„“”…-"


class Hashes(dict):
    """Word -> column; remembers at most ``KNOWN`` words, and is dropped with its task."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32((word.lower().strip(END) or word).encode("utf-8", "surrogatepass")) % FEATURES
        if len(self) < KNOWN:
            self[word] = found
        return found

    def all(self, words: pa.Array) -> np.ndarray:
        """Columns of distinct words without white space, -1 for an empty one.

        Arrow lower-cases and trims the ASCII words, which are then hashed without being remembered; the others are
        lower-cased as ``__missing__`` does, whose rules differ from Arrow's.
        """
        found = np.empty(len(words), np.int64)
        plain = pc.string_is_ascii(words)
        ascii, mask = words.filter(plain), plain.to_numpy(zero_copy_only=False)
        bare = pc.utf8_trim(pc.ascii_lower(ascii), characters=END)
        bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), ascii, bare).cast(pa.large_binary())
        sums = np.fromiter(map(zlib.crc32, bare.to_numpy(zero_copy_only=False).tolist()), np.int64, len(bare)) % FEATURES
        sums[pc.equal(pc.binary_length(ascii), 0).to_numpy(zero_copy_only=False)] = -1
        found[mask] = sums
        if not mask.all():
            rest = words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
            found[~mask] = np.fromiter(map(self.__getitem__, rest), np.int64, len(rest))
        return found


def columns_of(text: str | None, known: Hashes | None = None) -> np.ndarray:
    known = Hashes() if known is None else known
    words = (text or "").split()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def columns(texts: pa.Array, known: Hashes) -> list[np.ndarray]:
    """``columns_of`` each text: Arrow splits at the same white space and finds the distinct words, which are hashed."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    place = coded.indices.to_numpy()
    found = known.all(coded.dictionary)[place] if len(place) else np.empty(0, np.int64)
    word = found >= 0  # an empty string stands beside white space at a text's ends
    before = np.concatenate(([0], np.cumsum(word)))[ends - ends[0]]
    flat = found[word]
    return [flat[a:b] for a, b in zip(before, before[1:])]


def slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    """(first place, number) of neighbours with about CHARS bytes in all."""
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // CHARS)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        if b > a:
            yield a, b - a


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, words): each text's columns as little-endian 16-bit integers, written once for all that reads them."""
    @common.tidy
    def work(batches):
        known = Hashes()
        for b in batches:
            for at, n in slices(b.column(1)):
                words = [w.astype("<u2").tobytes() for w in columns(b.column(1).slice(at, n), known)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(words, pa.binary())], names=["doc_id", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stored(rows.mapInArrow(work, "doc_id bigint, words binary"), "words")


def unpacked(words: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(w, "<u2").astype(np.int64) for w in words]


def frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per column, and documents, over all rows of ``hashed``."""
    def work(batches):
        df, n, last, number = np.zeros(FEATURES, np.int64), 0, np.zeros(FEATURES, np.int64), np.arange(0)
        for b in batches:
            for packed in b.column(0):
                w = np.frombuffer(packed.as_buffer(), "<u2")
                if len(w) > len(number):
                    number = np.arange(2 * len(w))
                here = number[:len(w)]
                last[w] = here
                df[w[last[w] == here]] += 1  # each column once, where it stands last
                n += 1
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n))], names=["f", "n"])

    rows = words.select("words").mapInArrow(work, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # one row per column at most
    df, f, n = np.zeros(FEATURES), rows.column("f").to_numpy(), rows.column("n").to_numpy()
    df[f[f >= 0]] = n[f >= 0]
    return df, int(n[f < 0].sum())


def block_rows(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of each block, text number, first word): BLOCK columns a row; what repeats or is missing is FEATURES."""
    lengths = np.array([len(w) for w in words], np.int64)
    per = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(words)), per)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * BLOCK
    if not len(text):
        return np.zeros((0, BLOCK), np.int64), text, first
    starts = first + np.repeat(np.cumsum(lengths) - lengths, per)
    at = starts[:, None] + np.arange(BLOCK)
    flat = np.concatenate(words)
    row = np.where(at < np.append(starts[1:], lengths.sum())[:, None], flat[np.minimum(at, len(flat) - 1)], FEATURES)
    row.sort(axis=1)
    row[:, 1:][row[:, 1:] == row[:, :-1]] = FEATURES
    return row, text, first


def summed(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each row's columns; ``weights`` ends with a row of zeros for FEATURES."""
    sums = weights.take(row[:, 0], axis=0)
    one = np.empty_like(sums)
    for k in range(1, BLOCK):
        sums += weights.take(row[:, k], axis=0, out=one, mode="clip")  # the mode spares a second buffer
    return sums


def padded(weights: np.ndarray) -> np.ndarray:
    """``weights`` and a zero, a column's numbers side by side in memory, whatever the order they come in."""
    return np.concatenate((np.ascontiguousarray(weights), np.zeros((1, *weights.shape[1:]), weights.dtype)))


def block_sums(words: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of texts, (passages, their first blocks, text number, first word); a word counts once in a block, so repeats weigh little."""
    row, text, first = block_rows(words)
    if not len(text):
        none = np.zeros((0, weights.shape[1]), weights.dtype)
        return none, none, text, first
    sums = summed(row, padded(weights))
    joined = np.nonzero(text[1:] == text[:-1])[0]
    out = sums.copy()
    out[joined] += sums[joined + 1]
    return out, sums, text, first


def passages(words: np.ndarray) -> list[np.ndarray]:
    return [words[at:at + 2 * BLOCK] for at in range(0, max(len(words) - BLOCK, 1), BLOCK)] if len(words) else []


def _summed(rows: DataFrame, size: int, work) -> tuple[np.ndarray, np.ndarray, float]:
    """(Y'Y, A'Y, weight of the passages) from ``work``, which gives these three for an iterator of batches, added up over the tasks."""
    names = [f"y{i}" for i in range(size)]

    @common.tidy
    def task(batches):
        gram, cross, n = work(batches)
        some = np.nonzero(cross.any(axis=1))[0]
        count = np.zeros((1, size))
        count[0, 0] = n
        # in parts, as a table of all columns would stand several times over in the worker
        parts = [some[at:at + GROUP] for at in range(0, len(some), GROUP)]
        for f, values in chain(((p, cross[p]) for p in parts), [(-1 - np.arange(size + 1), np.concatenate((gram, count)))]):
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(size))], names=["f", *names])

    schema = "f int, " + ", ".join(f"{n} double" for n in names)
    found = rows.mapInArrow(task, schema).groupBy("f").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # FEATURES + size + 1 rows at most
    # batch by batch into one table, as the driver holds few of this size; the sums without a column stand at its end
    table = np.zeros((FEATURES + size + 1, size))
    for b in found.to_batches():
        f = b.column("f").to_numpy()
        at = np.where(f < 0, FEATURES - 1 - f, f)
        for i, n in enumerate(names):
            table[at, i] = b.column(n).to_numpy()
    return table[FEATURES:-1], table[:FEATURES], float(table[-1, 0])


def _pass(rows: DataFrame, idf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all passages of Y'Y and A'Y for Y = A w, with unit rows in A, and their number; rows: text, the first column."""
    size = w.shape[1]

    def work(batches):
        gram, cross, n, known = np.zeros((size, size)), np.zeros((FEATURES, size)), 0, Hashes()
        for b in batches:
            for text in b.column(0).to_pylist():
                for p in passages(columns_of(text, known)):
                    at, times = np.unique(p, return_counts=True)
                    a = np.minimum(times, 2) * idf[at]
                    a = a / (np.linalg.norm(a) or 1)
                    y = a @ w[at]
                    gram += np.outer(y, y)
                    cross[at] += a[:, None] * y
                    n += 1
        return gram, cross, n

    return _summed(rows, size, work)


def block_pass(words: list[np.ndarray], idf: np.ndarray, weights: np.ndarray, gram: np.ndarray, cross: np.ndarray) -> float:
    """Add a group's sums to ``gram`` and to ``cross``, which is transposed and lacks the factor idf; gives the passages' weight.

    A passage is the sum of two neighbouring blocks, so a block's products with W serve both passages it stands in, and
    so does its part of A'Y.  ``idf`` and ``weights`` (idf times W) end with a zero.
    """
    row, text, _ = block_rows(words)
    alone = np.ones(len(text) + 1, bool)
    alone[1:-1] = text[1:] != text[:-1]
    # every block but a text's last opens a passage, and so does the only block of a text
    opens = np.nonzero(~alone[1:] | alone[:-1] & alone[1:])[0]
    number = np.bincount(text[opens], minlength=1)
    share = np.minimum(1, EACH / np.maximum(1, number))[text[opens]]
    for at in range(0, len(opens), GROUP):
        i = opens[at:at + GROUP]
        low = i[0]
        here = row[low:i[-1] + 2]
        two = ~alone[i + 1]
        i = i - low
        j = i[two] + 1
        z = summed(here, weights)
        y = z[i]
        y[two] += z[j]
        square = idf * idf
        own = square[here].sum(axis=1)
        norm = own[i]
        both = np.sort(np.concatenate((here[i[two]], here[j]), axis=1), axis=1)
        norm[two] += own[j] + 2 * np.where(both[:, 1:] == both[:, :-1], square[both[:, 1:]], 0).sum(axis=1)
        norm = np.sqrt(norm)[:, None].astype(y.dtype)
        norm[norm == 0] = 1
        y /= norm
        part = share[at:at + GROUP, None]
        wide = y * np.sqrt(part)
        gram += wide.T @ wide
        y = y / norm * part
        v = np.zeros(z.shape)
        v[i] = y
        v[j] += y[two]
        flat = here.ravel()
        word = np.flatnonzero(flat < FEATURES)
        flat, block = flat[word], word // BLOCK
        each = np.empty(len(flat))
        for k, values in enumerate(np.ascontiguousarray(v.T)):
            cross[k] += np.bincount(flat, values.take(block, out=each, mode="clip"), FEATURES)
    return float(share.sum())


def _documents(words: DataFrame, idf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """As ``_pass``, over all passages of the rows of ``hashed``; a word counts once in each of a passage's two blocks."""
    size = w.shape[1]
    weights, ends = np.zeros((FEATURES + 1, size), np.float32), padded(idf)
    np.multiply(idf[:, None], w, out=weights[:-1], casting="same_kind")

    def work(batches):
        gram, cross, n = np.zeros((size, size)), np.zeros((size, FEATURES)), 0.0
        for b in batches:
            for _, texts in _groups(b.column(0)):
                n += block_pass(texts, ends, weights, gram, cross)
        cross *= idf
        return gram, cross.T, n

    # a task gives up to FEATURES rows, so there are as many as cores, whatever the number of documents
    tasks = words.sparkSession.sparkContext.defaultParallelism
    return _summed(words.select("words").coalesce(tasks), size, work)


def latent(rows: DataFrame, idf: np.ndarray, rank: int = RANK, power: int = 1, words: DataFrame | None = None) -> np.ndarray:
    """(FEATURES, rank) weights: TF-IDF times whitened right singular vectors of the passages of texts and of all hashed documents."""
    rows = rows.select("text")
    w = np.random.default_rng(0).standard_normal((FEATURES, rank + OVER))
    for k in range(power + 1):
        gram, cross, n = _pass(rows, idf, w)
        if k == power and words is not None:
            other = _documents(words, idf, w)
            weight = min(1.0, max(LEAST, SHARE * n) / max(1, other[2]))
            gram += weight * other[0]
            cross += np.multiply(other[1], weight, out=other[1])
            del other
        values, turn = np.linalg.eigh(gram)
        some = values > 1e-10 * max(values.max(), 1e-300)
        small = cross @ (turn[:, some] / np.sqrt(values[some]))  # A'Q for the Q that spans Y
        # each is as large as the table of all columns: the driver lets go of it before the next step makes more
        del gram, cross
        if k < power:
            w /= np.sqrt(FEATURES)  # what the texts do not span stays random
            w[:, :small.shape[1]] = np.linalg.qr(small)[0]
            del small
        common.give_back()
    del w
    u, s, _ = np.linalg.svd(small, full_matrices=False)
    keep = s > 1e-6 * max(s.max(initial=0), 1e-300)
    # whitening evens out what is cut at ``rank``; a space that holds all of A keeps the cosines of A, or its few rows would all be apart
    size = s if keep.sum() > rank else np.ones_like(s)
    del small
    u = u[:, np.flatnonzero(keep)[:rank]]
    u /= size[keep][:rank]
    u *= idf[:, None]
    found = u.astype(np.float32, order="C")
    del u
    common.give_back()
    return found


def subsequence(short: list, long: list) -> int:
    """Length of the longest common subsequence, a word of ``long`` per step on a row of bits."""
    where: dict = {}
    for i, w in enumerate(short):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(short)) - 1
    row = full
    for w in long:
        if m := where.get(w):
            x = row & m
            row = (row + x | row - x) & full
    return len(short) - row.bit_count()


class Items:
    """A block of items with their latent passages and answers."""

    def __init__(self, rows: list[tuple], weights: np.ndarray):
        self.ids = [i for i, _ in rows]
        self.words = [columns_of(t) for _, t in rows]
        self.lists = [w.tolist() for w in self.words]
        self.answers = [columns_of(SENTENCE.split((t or "").strip())[-1]).tolist() for _, t in rows]
        # which columns an item has, a bit each, and how often: the keys are item * FEATURES + column
        self.bag = np.zeros((len(rows), FEATURES // 8), np.uint8)
        key = np.concatenate([i * FEATURES + w for i, w in enumerate(self.words)] or [np.empty(0, np.int64)])
        self.key, self.times = np.unique(key, return_counts=True)
        item, column = np.divmod(self.key, FEATURES)
        np.bitwise_or.at(self.bag, (item, column >> 3), (1 << (column & 7)).astype(np.uint8))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.most = np.zeros(len(rows), np.int64)
        np.maximum.at(self.most, item, self.times)
        self.weights = weights
        vectors, _, item, first = block_sums(self.words, weights)
        # the last block stands in the passage before it, unless it is the only one
        some = np.nonzero((first == 0) | (first + BLOCK < np.array([len(w) for w in self.words], np.int64)[item]))[0]
        self.item, self.vectors = item[some], _unit(vectors[some])
        # a short item is one vector of all its words
        self.short = np.nonzero((0 < self.sizes) & (self.sizes <= SHORT))[0]
        whole = [weights[np.unique(self.words[i])].sum(axis=0) for i in self.short]
        self.short_vectors = _unit(np.array(whole, weights.dtype).reshape(len(whole), weights.shape[1]))

    def check(self, item: int, words: np.ndarray, first: int, least: float) -> tuple[float, float]:
        """Shares of the item and of its answer around a passage and its neighbours; zeros if the item's is below ``least``."""
        n = len(self.lists[item])
        near = words[max(0, first - n - BLOCK):first + 3 * BLOCK + n].tolist()
        share = subsequence(self.lists[item], near) / n
        if share < least:
            return 0.0, 0.0
        answer = self.answers[item]
        return share, (subsequence(answer, near) / len(answer) if answer else 0.0)


    def shared(self, item: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """Share of each item's words that occur in flat[begin:end], which no common subsequence exceeds; zero where it is below ``least``."""
        out = np.zeros(len(item))
        place, bit = flat >> 3, (1 << (flat & 7)).astype(np.uint8)
        bag, wide = self.bag.ravel(), self.bag.shape[1]
        cuts = np.flatnonzero(np.diff(np.cumsum(end - begin) // CHARS)) + 1  # about CHARS words at a time
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)]):
            who, size = item[lo:hi], end[lo:hi] - begin[lo:hi]
            before = np.cumsum(size) - size
            at = np.repeat(begin[lo:hi] - before, size)
            at += np.arange(len(at))
            byte = place[at]
            byte += np.repeat(who * wide, size)
            hit = np.flatnonzero(bag[byte] & bit[at])
            pair = np.searchsorted(before + size, hit, side="right")
            # a word counts as often as the item has it, so hits times the most frequent word's count are no less than the share
            some = np.bincount(pair, minlength=len(who)) * self.most[who] >= least * self.sizes[who]
            kept = some[pair]
            pair, column = np.divmod(np.unique(pair[kept] * FEATURES + flat[at[hit[kept]]]), FEATURES)
            times = self.times[np.searchsorted(self.key, who[pair] * FEATURES + column)]
            out[lo:hi] = np.bincount(pair, times, len(who)) / np.maximum(self.sizes[who], 1)
        return np.where(out >= least, out, 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def _groups(packed: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts in groups of about WORDS words."""
    held, words, size = [], [], 0
    for first, n in slices(packed):
        for k, w in enumerate(unpacked(packed.slice(first, n).to_pylist()), first):
            held.append(k)
            words.append(w)
            size += len(w)
            if size >= WORDS:
                yield held, words
                held, words, size = [], [], 0
    if held:
        yield held, words


def candidates(words: list[np.ndarray], items: Items, cosine: float, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, first word, cosine) of passages near an item passage, the nearest first for each text and item.

    Passages around which less than ``least`` of the item's words occur in any order are no candidates.  A passage next
    to one that came before for the same text and item is left out, as a check looks at both neighbours.
    """
    for k, w in enumerate(words):
        if len(w) > 2 * WORDS:  # a text of many words goes through in parts that share a passage
            for at in range(0, len(w), WORDS):
                for _, item, first, c in candidates([w[at:at + WORDS + 2 * BLOCK]], items, cosine, least):
                    yield k, item, at + first, c
    words = [w if len(w) <= 2 * WORDS else w[:0] for w in words]
    vectors, singles, text, first = block_sums(words, items.weights)
    flat = np.concatenate(words) if words else np.empty(0, np.int64)
    begin = np.cumsum([0] + [len(w) for w in words])
    found: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for vectors, others, item in ((_unit(vectors), items.vectors, items.item), (_unit(singles), items.short_vectors, items.short)):
        step = max(1, 4_000_000 // max(1, len(others)))
        for at in range(0, len(vectors) if len(others) else 0, step):
            near = vectors[at:at + step] @ others.T
            i, j = np.divmod(np.flatnonzero(near >= cosine), near.shape[1])
            c, who, spot, t = near[i, j], item[j], first[at + i], text[at + i]
            size = items.sizes[who]
            lo = begin[t] + np.maximum(0, spot - size - BLOCK)
            hi = np.minimum(begin[t + 1], begin[t] + spot + 3 * BLOCK + size)
            good = items.shared(who, flat, lo, hi, least - 1e-9) > 0
            for row in zip(t[good].tolist(), who[good].tolist(), c[good].tolist(), spot[good].tolist()):
                found.setdefault(row[:2], []).append((-row[2], row[3]))
    for (k, item), spots in found.items():
        seen: set[int] = set()
        for c, spot in sorted(spots):
            if seen.isdisjoint((spot - BLOCK, spot, spot + BLOCK)):
                seen.add(spot)
                yield k, item, spot, -c


def search(words: DataFrame, items: Items, cosine: float, copied: float, paraphrased: float) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer, word) of the rows of ``hashed`` that hold an item of the block."""
    @common.tidy
    def work(batches):
        for b in batches:
            names, out = b.column(0).to_pylist(), []
            for held, words in _groups(b.column(1)):
                done: set[tuple[int, int]] = set()
                for k, item, first, c in candidates(words, items, cosine, min(copied, paraphrased)):
                    if (k, item) in done:
                        continue
                    overlap, answer = items.check(item, words[k], first, min(copied, paraphrased))
                    if overlap >= copied or overlap >= paraphrased and answer >= copied:
                        done.add((k, item))
                        out.append((names[held[k]], items.ids[item], c, overlap, answer, first))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=fields)

    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    fields = ["doc_id", "item_id", "cosine", "overlap", "answer", "word"]
    return words.mapInArrow(
        work, "doc_id bigint, item_id bigint, cosine double, overlap double, answer double, word bigint")


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of ITEMS; the driver holds one block at a time."""
    held = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == ITEMS:
            yield held
            held = []
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, copied: float = 0.8, paraphrased: float = 0.6, rank: int = RANK,
) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer, word): documents that hold a copy or a paraphrase of an item."""
    common.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    words = hashed(rows)
    df, n = frequencies(words)
    idf = np.log((n + 1) / (df + 1))
    weights = latent(benchmark, idf, rank, words=words)
    found = None
    for block in blocks(benchmark):
        part = search(words, Items(block, weights), cosine, copied, paraphrased)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = search(words, Items([], weights), cosine, copied, paraphrased)
    common.give_back()
    best = F.max(F.struct("overlap", "cosine", "answer", "word")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.overlap", "x.answer", "x.word")


@common.query("op10_decontam")
def op10(spark, sf_dir):
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
