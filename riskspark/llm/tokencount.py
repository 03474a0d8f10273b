"""Token counts: whole texts are encoded in Arrow batches, and only lengths come back.

A batch of rows is dealt into calls of about ``CHARS`` characters, so one call's memory does not depend on how long the
texts are; a longer text is cut at spaces between two visible characters, where no piece crosses, and its parts' counts
are added.  Works with the tokenizers library (``.json``) and the sentencepiece library (``.model``).

Cases: a null text is empty (0 tokens); null or repeated doc_ids and repeated rows are counted row by row; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm import chunks, common


def encoder(path: str) -> chunks.Chunked:
    return chunks.pieces(path) if path.endswith(".model") else chunks.byte_level(path)


def lengths(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text."""
    out, known = np.zeros(len(texts), np.int64), encoder(path)
    # byte-level texts keep the space that a cut would take, so they are not cut
    dealt = chunks.batches(texts) if path.endswith(".model") else chunks.batches(texts, max(map(len, filter(None, texts)), default=0) + chunks.CHARS)
    for owners, parts in dealt:
        np.add.at(out, owners, known.lengths(parts))
    return out


def count(docs: DataFrame, tokenizer: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    common.small_batches(docs.sparkSession)
    path = tokenizer or chunks.path_of("piece_bpe_32k.model")

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lengths(b.column(2).to_pylist(), path))], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


@common.query("op13_counts")
def op13(spark, sf_dir):
    return count(common.table(spark, sf_dir, "documents"))
