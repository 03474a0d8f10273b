"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

1. quality_classifier: documents that the compression classifier rejects go.
2. line_dedup: repeated multi-line chunks are cut out; documents of which less than a fifth is left go, as copies.
3. simhash_near_dedup: the smallest doc_id of each group of near copies stays.
4. benchmark_decontamination: documents with a copy or paraphrase of a benchmark item go.
5. best_fit_packing: what is left as pieces in sequences.

Cases, in every stage: an empty table gives an empty one.  A null text passes the first stage by the score of an empty
text, and the others as a text that holds nothing; rows with a null doc_id are judged row by row, by id and text together;
repeated rows share one fate, and the third stage keeps one of them.  Extra columns pass through the first four stages
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm import common, decontam, linechunks, packing, simhash, zquality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return zquality.keep(docs, zquality.fit(docs, common.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chars = common.fresh(docs, "chars")
    rows = docs.withColumn(chars, F.length("text"))
    left = linechunks.remove(rows).where((F.col("chunks_removed") == 0) | (5 * F.length("text") >= F.col(chars)))
    return left.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by id and text, as an id may be null or repeated
    row, leak = F.xxhash64("doc_id", "text"), common.fresh(docs, "leak")
    leaks = decontam.contaminated(docs.select(row.alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return docs.join(common.stored(leaks.select(F.col("doc_id").alias(leak)).distinct(), "leaks"), row == F.col(leak), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # the first stage cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
