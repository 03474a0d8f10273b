"""Quality rules with cross-document line frequency; DataFrame functions only.

Words are runs of characters other than space and 0x09-0x0D.  Base figures of a text:

    n_words         words
    word_chars      code points in words
    n_symbols       characters of ``#*$%&|<>``
    n_dup_lines     lines with a word that equal an earlier line
    n_repeat_words  words in 8-word windows that occur twice or more in the text, the first included

``base_failed``: fewer than 20 words, or more than 30 % of the words repeat.

Line frequency: a line is normalised (lower case, white space collapsed and trimmed) and hashed; each document counts once
per line and host.  Lines in more than ``share`` of a host's documents, and in more than ``least`` documents, are removed;
a document of which less than ``left`` of its words stays is rejected.  Counts cover all rows; a line's count is summed
before the shuffle, so a line in every document of a large host costs one row per task.

Cases: a null text has no words and fails the base rule; a null host is a host of its own; each row is a document, so
repeated rows count each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import common

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row_id, doc_id, host, the base figures, lines array<struct<h, words>>) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    rows = rows.select(
        "row_id", "doc_id", "host",
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
        F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    n = F.size("w")
    rows = rows.select(
        "row_id", "doc_id", "host", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(
            line_hash(x).alias("h"), F.size(_words(x)).alias("words"))).alias("lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).alias("windows"))
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("at", F.array_sort(F.transform(
        F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get("sorted", i + 1)["h"]).eqNullSafe(True)),
        lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    return rows.select(
        "row_id", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "lines")


def frequent_lines(rows: DataFrame, share: float = 0.1, least: int = 10) -> DataFrame:
    """(host, h, docs) of the lines above the limits."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
    hosts = hosts.withColumnRenamed("host", "of")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") > share * F.col("host_docs")).select("host", "h", "docs")


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 20, max_repeat: int = 30, share: float = 0.1, least: int = 10, left: float = 0.2,
) -> DataFrame:
    """Figures and verdict of every row: base_failed, lines_removed, words_removed, cut (hashes of the lines removed), kept."""
    rows = common.stored(figures(docs, id_col, text_col, host_col), "figures")
    often = frequent_lines(rows, share, least).select(F.col("host").alias("of"), F.col("h").alias("often"))
    lines = rows.select("row_id", "host", F.explode("lines").alias("x")).select("row_id", "host", "x.h", "x.words")
    removed = lines.join(often, (F.col("h") == F.col("often")) & F.col("host").eqNullSafe(F.col("of")), "left_semi").groupBy("row_id").agg(
        F.count("*").alias("lines_removed"), F.sum("words").alias("words_removed"), F.collect_set("h").alias("cut"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (F.col("words_removed") > 0) & (F.col("n_words") - F.col("words_removed") < left * F.col("n_words"))
    rows = rows.drop("lines").join(removed, "row_id", "left").fillna(0, ["lines_removed", "words_removed"])
    return rows.drop("row_id").withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Rows of ``docs`` that are kept, the frequent lines cut out of their text, and ``lines_removed``; no column may be called ``_row``, ``_of``, ``_cut`` or ``_lines``."""
    rows = common.stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = apply_rules(rows, "_row", text_col, host_col, **limits).where("kept").select(F.col("doc_id").alias("_of"), F.col("cut").alias("_cut"), F.col("lines_removed").alias("_lines"))
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains("_cut", line_hash(x))), "\n")
    return rows.join(found, F.col("_row") == F.col("_of")).select(
        *[F.when(F.col("_cut").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else rows[c] for c in docs.columns],
        F.col("_lines").alias("lines_removed"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT r, source, doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT r, source, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM l
), lf AS (
  SELECT * FROM lw WHERE words > 0
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lf GROUP BY r
), hosts AS (
  SELECT source, count(*) AS n FROM d GROUP BY source
), often AS (
  SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT r) AS docs FROM lf GROUP BY source, norm) f JOIN hosts USING (source)
  WHERE docs > 10 AND docs > 0.1 * hosts.n
), removed AS (
  SELECT r, sum(words) AS words FROM lf JOIN often USING (source, norm) GROUP BY r
), w AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), g AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win FROM w, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8
), rep AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS t(k) GROUP BY r
), f AS (
  SELECT d.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(removed.words, 0) AS gone
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (gone > 0 AND n_words - gone < 0.2 * n_words) AS kept
FROM f
"""


@common.query("op9_linefreq", SQL)
def op9(spark, sf_dir):
    return apply_rules(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
