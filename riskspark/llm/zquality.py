"""Quality classifier by compression.

Two zstandard dictionaries are built from windows of good and of bad labelled text.  A text is compressed with each in
consecutive windows of the same size, each a frame of its own, so that its end meets the dictionaries as its start does;
the difference of the sizes, summed over all windows, over the text's length (plus ``SHRINK``, so that short texts say
little) is high where the good dictionary helps more.  A logistic fit on other labelled rows turns it into the probability
of label 1.

The fit reads a bounded sample: ``per_class`` labelled documents of each class, of which one part in ``CALIBRATE`` serves
calibration only, and ``windows`` text windows a class.  Every document is scored on its whole text.

Cases: null and empty texts get the score of difference 0; without labels of both classes every score is the share of
good labels (1 without labels); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import common, learning

WINDOW = 1000
DICT_BYTES = 256 * 1024
SHRINK = 200
CALIBRATE = 3


def dictionary(windows: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zs.train_dictionary(DICT_BYTES, windows).as_bytes()
    except zs.ZstdError:
        return b"".join(windows)[-DICT_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    constant: float | None = None

    def differences(self, texts: list[str | None]) -> np.ndarray:
        windows = [[t[i:i + WINDOW].encode("utf-8", "surrogatepass") for i in range(0, len(t), WINDOW)] if t else [] for t in texts]
        sizes = []
        for data in (self.good, self.bad):
            known = zs.ZstdCompressionDict(data)
            known.precompute_compress(level=3)
            pack = zs.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False).compress
            sizes.append([sum(len(pack(w)) for w in own) for own in windows])
        lengths = np.array([sum(map(len, own)) for own in windows], float)
        return (np.array(sizes[1], float) - np.array(sizes[0], float)) / (lengths + SHRINK)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.differences(texts), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", per_class: tuple[int, int] = (6000, 6000), windows: int = 16000) -> Model:
    """Learn from the labelled rows that ``where`` (on doc_id) allows."""
    common.small_batches(docs.sparkSession)
    where = F.lit(True) if where is None else where
    picked = learning.sample_labels(labels, label, where, per_class)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(CALIBRATE))
    picked = common.stored(picked.withColumn("calibrate", part == 0), "label-sample")
    counts = {r.label: r.n for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(b"", b"", 0, 0, counts.get(1, 0) / total if total else 1.0)
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked), "doc_id")  # the sample is bounded
    rows = common.stored(rows, "labelled-sample")
    pieces = rows.where("not calibrate").select(
        "label", "doc_id", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.length("text"), F.lit(WINDOW)), lambda i: F.substring(F.col("text"), i, F.lit(WINDOW)))).alias("at", "piece"))
    order = [F.xxhash64("doc_id", "at"), F.col("doc_id"), F.col("at")]
    trained = {}
    for k in (0, 1):  # one class after the other, so that the driver holds the windows of one; the tasks pick them, by a shuffle
        chosen = pieces.where(F.col("label") == k).orderBy(*order).limit(windows).select("piece").toArrow()
        if not chosen.num_rows:
            return Model(b"", b"", 0, 0, counts[1] / total)
        trained[k] = dictionary(chosen.column(0).cast(pa.large_binary()).to_pylist())
        del chosen
        common.give_back()
    model = Model(trained[1], trained[0], 0, 0)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.differences(b.column(1).to_pylist()))], names=["label", "d"])

    seen = rows.where("calibrate").select("label", "text").mapInArrow(work, "label int, d double").collect()
    y, x = np.array([r.label for r in seen], float), np.array([r.d for r in seen])
    if not 0 < y.sum() < len(y):
        model.constant = counts[1] / total
        return model
    # classes were sampled apart: weigh them as they occur among the allowed labels
    share = labels.where(where & F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.intercept, model.slope = learning.logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    common.small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """Rows of ``docs`` whose text scores ``limit`` or more; no shuffle."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    @common.tidy
    def work(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist()) >= limit))

    return docs.mapInArrow(work, docs.schema)


@common.query("op6_zquality")
def op6(spark, sf_dir):
    docs, held = common.table(spark, sf_dir, "documents"), learning.fold(F.col("doc_id"), 4) == 2
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
