"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and their first four to seven characters (marked ``*``).  From a bounded sample of labelled
documents the terms that speak for toxicity are chosen by log-likelihood ratio and purity; document frequencies of the chosen
terms are counted over all documents.  Sampled documents that hold a chosen term are the examples.

The examples' inverted index is cut into blocks of ``BLOCK`` examples and keeps each term's largest weight per block.  A
document's blocks are visited by falling upper bound, until none can reach the k-th best cosine, so the k nearest are
exact.  Votes are weighted by cosine; leave-one-out votes of the examples calibrate them, and documents without a chosen
term get the rate of toxic ones among such labelled documents.  The nearest examples are the evidence.

Cases: null and empty texts have no term; ties in cosine go to the smaller example number; without labels of both classes
every score is the share of toxic labels (0 without labels); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import common, learning

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)
BLOCK = 64
NEAREST = 15


def terms(text: str | None) -> Counter:
    counts = Counter(WORD.findall((text or "").lower()))
    for word, n in list(counts.items()):
        for k in PREFIXES:
            if len(word) > k:
                counts[word[:k] + "*"] += n
    return counts


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], size: int):
        # examples with the same leading term share blocks, which keeps the bounds tight
        lead = [max(v, key=lambda t: (v[t], -t)) for v in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        self.blocks = -(-len(vectors) // BLOCK)
        postings: dict[int, tuple[list[int], list[float]]] = {}
        for slot, i in enumerate(self.order.tolist()):
            for t, w in vectors[i].items():
                at, ws = postings.setdefault(t, ([], []))
                at.append(slot)
                ws.append(w)
        self.postings = {}
        for t, (at, ws) in postings.items():
            at, ws = np.array(at, np.int64), np.array(ws)
            top = np.zeros(self.blocks)
            np.maximum.at(top, at // BLOCK, ws)
            self.postings[t] = (at, ws, top, np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK))

    def nearest(self, query: dict[int, float], k: int, but: int = -1) -> tuple[list[int], list[float]]:
        """Example numbers and cosines of the k nearest, ``but`` left out."""
        own = [(w, *self.postings[t]) for t, w in sorted(query.items()) if t in self.postings]
        if not own:
            return [], []
        bound = sum(w * top for w, _, _, top, _ in own)
        found: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(found) >= k and bound[b] < -found[k - 1][0] - 1e-12:
                break
            held = np.zeros(BLOCK)
            for w, at, ws, _, cut in own:
                x, y = cut[b], cut[b + 1]
                held[at[x:y] - b * BLOCK] += w * ws[x:y]
            slots = np.nonzero(held)[0]
            found += [(-round(float(held[s]), 12), i) for s in slots.tolist() if (i := int(self.order[b * BLOCK + s])) != but]
            found = sorted(found)[:k]
        return [i for _, i in found], [-c for c, _ in found]


@dataclass
class Model:
    vocabulary: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    examples: list[dict[int, float]] = field(default_factory=list)
    ids: list = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    intercept: float = 0.0
    slope: float = 0.0
    silent: float = 0.0
    constant: float | None = None
    index: BlockMaxIndex | None = None

    def vector(self, at: list[int], tf: list[int]) -> dict[int, float]:
        w = {t: (1 + np.log(n)) * self.idf[t] for t, n in zip(at, tf)}
        size = sum(x * x for x in w.values()) ** 0.5
        return {t: float(x / size) for t, x in w.items()}

    def votes(self, vector: dict[int, float], but: int = -1) -> tuple[float, list[int], list[float]]:
        who, near = self.index.nearest(vector, NEAREST, but)
        total = sum(near)
        return (sum(c * self.labels[i] for i, c in zip(who, near)) / total if total else 0.0), who, near

    def score(self, vote: float) -> float:
        return learning.sigmoid(self.intercept + self.slope * vote)


VECTOR = "array<struct<t: int, n: int>>"


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, vector): the chosen terms of every text with their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.list_(pa.struct([("t", pa.int32()), ("n", pa.int32())]))
    # a word cannot hold a chosen term unless it or one of its prefixes is one: words are looked up once per worker batch
    def work(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                counts: Counter = Counter()
                for word, n in Counter(WORD.findall((text or "").lower())).items():
                    if (t := vocabulary.get(word)) is not None:
                        counts[t] += n
                    for k in PREFIXES:
                        if len(word) > k and (t := vocabulary.get(word[:k] + "*")) is not None:
                            counts[t] += n
                out.append([{"t": t, "n": n} for t, n in sorted(counts.items())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow)], names=["doc_id", "vector"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, vector {VECTOR}")


def choose(rows: DataFrame, size: int, least: int, ratio: float, purity: float, share: float) -> list[str]:
    """Terms whose presence speaks for toxicity, from (label, text); ``share`` is that of toxic documents before sampling."""
    def work(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in terms(text):
                    seen.setdefault(t, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())],
            names=["term", "toxic", "clean"])

    n1, n0 = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    counts = rows.select("label", "text").mapInArrow(work, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= least)
    a, b, p = F.col("a"), F.col("b"), n1 / (n1 + n0)
    toxic, clean = a * (share / n1), b * ((1 - share) / n0)
    g2 = 2 * (a * F.log(a / ((a + b) * p)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - p)))).otherwise(0))
    found = counts.where(toxic >= purity * (toxic + clean)).withColumn("g2", g2).where(F.col("g2") >= ratio).orderBy(F.desc("g2"), "term").limit(size)
    return sorted(r.term for r in found.select("term").collect())


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", per_class: tuple[int, int] = (6000, 20000),
        size: int = 4096, least: int = 4, ratio: float = 15.0, purity: float = 0.9) -> tuple[Model, DataFrame]:
    """The model, and the stored vectors of all documents.  At most ``per_class`` toxic and clean documents are examples."""
    common.small_batches(docs.sparkSession)
    where = F.lit(True) if where is None else where
    picked = common.stored(learning.sample_labels(labels, label, where, per_class), "label-sample")
    counts = {r.label: r.n for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = labels.where(where & F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or 0.0
    model = Model(constant=share)
    rows = common.stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["text"]), "labelled-sample") if len(counts) > 1 else None  # the sample is bounded; copies count once
    if rows is not None and rows.select("label").distinct().count() > 1:
        model.vocabulary = {t: i for i, t in enumerate(choose(rows, size, least, ratio, purity, share))}
    found = common.stored(vectors(docs, model.vocabulary), "term-vectors")
    if not model.vocabulary:
        return model, found
    n = found.count()
    df = found.select(F.explode("vector.t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # one row per chosen term
    model.idf = np.ones(len(model.vocabulary))
    for r in df:
        model.idf[r.t] = 1 + np.log(n / r.n)
    held = vectors(rows, model.vocabulary).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "vector"])
    held = held.orderBy("doc_id").collect()
    some = [r for r in held if r.vector]
    model.ids, model.labels = [r.doc_id for r in some], [r.label for r in some]
    model.examples = [model.vector([x.t for x in r.vector], [x.n for x in r.vector]) for r in some]
    if not some:
        return model, found
    model.index = BlockMaxIndex(model.examples, len(model.vocabulary))
    spark = docs.sparkSession

    def work(batches):
        for b in batches:
            at = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([model.votes(model.examples[i], i)[0] for i in at])], names=["id", "vote"])

    votes = {r.id: r.vote for r in spark.range(len(some)).mapInArrow(work, "id long, vote double").collect()}
    y, x = np.array(model.labels, float), np.array([votes[i] for i in range(len(some))])
    silent = np.array([r.label for r in held if not r.vector], float)
    w1, w0 = share / max(1, counts[1]), (1 - share) / max(1, counts[0])  # classes were sampled apart
    # one imagined example of each class at the ends keeps the fit finite where votes divide the classes
    x, y = np.append(x, (0.0, 1.0)), np.append(y, (0.0, 1.0))
    weight = np.where(y == 1, w1, w0)
    model.intercept, model.slope = learning.logistic(x, y, weight / weight.mean())
    toxic, clean = float(silent.sum()) * w1, float((1 - silent).sum()) * w0
    model.silent = (toxic + w1) / (toxic + clean + w1 + w0) if toxic + clean else 0.0
    model.constant = None
    return model, found


def score(found: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """(doc_id, score, vote, evidence array<struct<doc_id, cosine, label>>) of every row of the vectors."""
    kind = found.schema["doc_id"].dataType.simpleString()
    empty = model.silent if model.constant is None else model.constant

    def work(batches):
        known: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for vector in b.column(1).to_pylist():
                if not vector or model.constant is not None:
                    out.append((empty, 0.0, []))
                    continue
                key = tuple((x["t"], x["n"]) for x in vector)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    vote, who, near = model.votes(model.vector([t for t, _ in key], [n for _, n in key]))
                    known[key] = (model.score(vote), vote, [{"doc_id": model.ids[i], "cosine": c, "label": model.labels[i]} for i, c in zip(who[:evidence], near)])
                out.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))],
                names=["doc_id", "score", "vote", "evidence"])

    return found.mapInArrow(work, f"doc_id {kind}, score double, vote double, evidence array<struct<doc_id: bigint, cosine: double, label: int>>")


@common.query("op8_toxicity")
def op8(spark, sf_dir):
    docs, held = common.table(spark, sf_dir, "documents"), learning.fold(F.col("doc_id"), 3) == 1
    model, found = fit(docs, common.table(spark, sf_dir, "labels"), ~held)
    return score(found, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.expr("transform(evidence, x -> x.doc_id)").alias("evidence"))
