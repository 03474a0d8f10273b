"""Removal of repeated line passages by content-defined chunks; DataFrame functions only.

A text is split at line feeds.  A line's hash is the first 32 bits of its MD5; a rolling hash runs over the last
``WINDOW`` line hashes.  Chunking f of ``CHUNKINGS`` ends a chunk after each line whose rolling hash has bit f unset, so
its boundaries depend on the lines at them only, and lines put in or left out elsewhere do not move them; several
chunkings cover what one loses at the ends of a passage, one more takes each text as one chunk, and one each line of
``LONG`` words or more, which is as much as several lines elsewhere.  Chunks of two lines or one such line whose text occurs more than once in
all documents are removed but for the first occurrence (least doc_id, then place).  A chunk that goes has an earlier
equal one, so of all occurrences of a line the first always stays.

Hashes find candidates.  Bytes decide: all lines of candidates are compared byte for byte under their 64-bit hash, each
distinct line once; where no two different lines share a hash, chunks are equal if their sequences of line hashes are.
If lines ever share one, the chunks' whole texts are compared instead.

Cases: a null text stays null; an empty text has one empty line and no chunk; rows with the same doc_id and text count as
one document and are treated alike; blank lines are lines; an empty table gives an empty table; other columns pass
through unread whatever their names, but for ``chunks_removed`` and ``lines_removed``, whose place the new ones take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm import common

WINDOW = 2
BASE = 31
PRIME = 1_000_003
CHUNKINGS = 4
WHOLE, LINES = CHUNKINGS, CHUNKINGS + 1
LONG = 50
SEND_ROWS = 1_000_000


def _chunks(lines: Column, rolled: Column, f: int) -> Column:
    """array<struct<f, at, first, n>> of one chunking's chunks with two lines or a long one; lines are numbered from 0."""
    last = F.size(lines) - 1
    chunk = lambda a, n: F.struct(F.lit(f).alias("f"), a.alias("at"), a.alias("first"), n.alias("n"))
    if f == LINES:
        long = lambda i: F.length(F.get(lines, i)) - F.length(F.replace(F.get(lines, i), F.lit(" "), F.lit(""))) >= LONG - 1
        return F.transform(F.filter(F.sequence(F.lit(0), last), long), lambda i: chunk(i, F.lit(1)))
    if f == WHOLE:
        ends = F.array(last)
    else:
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(rolled, i).bitwiseAND(1 << f) == 0))
    starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    return F.filter(
        F.zip_with(starts, ends, lambda a, b: chunk(a, b - a + 1)),
        lambda c: c["n"] >= 2)


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limited: bool = False) -> DataFrame:
    """(doc_id, _hash, f, at, first, n, h, ids, own): every chunk of two lines or a long one with its lines; h is the hash of their ids.

    If ``limited``, a column ``_wanted`` of ``docs``, set<struct<f, at>>, limits the chunks to those.
    """
    wanted = F.col("_wanted") if limited else F.lit(None)
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_hash"), F.split(text_col, "\n").alias("lines"), wanted.alias("_wanted"))
    rows = rows.withColumn("hashes", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")))
    # the first line has no full window: its rolling hash counts as having every bit, so no chunk ends there
    rolled = F.transform("hashes", lambda h, i: F.coalesce(F.pmod(sum((F.get("hashes", i - k) * BASE**k for k in range(1, WINDOW)), h), F.lit(PRIME)), F.lit(-1)))
    rows = rows.select("doc_id", "_hash", "lines", "_wanted", F.transform("lines", line_id).alias("all"), rolled.alias("rolled"))
    every = F.concat(*[_chunks(F.col("lines"), F.col("rolled"), f) for f in range(LINES + 1)])
    if limited:
        every = F.filter(every, lambda c: F.array_contains("_wanted", F.struct(c["f"].alias("f"), c["at"].alias("at"))))
    rows = rows.select("doc_id", "_hash", "lines", "all", F.explode(every).alias("c"))
    part = lambda name: F.slice(name, F.col("c.first") + 1, F.col("c.n"))
    return rows.select("doc_id", "_hash", "c.*", part("all").alias("ids"), part("lines").alias("own")).withColumn("h", F.xxhash64("ids"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunks whose hash occurs more than once.

    Up to ``SEND_ROWS`` such hashes are sent to the tasks; beyond that places are joined by hash, gathered by document, and
    meet the texts there, so a text still travels once at most.
    """
    found = chunks(docs, id_col, text_col)
    often = common.stored(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "chunk-hashes")
    if often.count() <= SEND_ROWS:
        return found.join(F.broadcast(often), "h", "left_semi")
    places = found.select("doc_id", "_hash", "f", "at", "h").join(often, "h", "left_semi").groupBy("doc_id", "_hash").agg(
        F.collect_set(F.struct("f", "at")).alias("_wanted")).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_of"))
    rows = rows.join(places, (F.col("_of") == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id"))).select(id_col, text_col, "_wanted")
    return chunks(rows, id_col, text_col, limited=True)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _hash, f, at, first, n) of every chunk that an earlier chunk equals byte for byte."""
    found = candidates(docs, id_col, text_col)
    pairs = found.select(F.explode(F.arrays_zip("ids", "own")).alias("x")).select("x.ids", "x.own").distinct()
    shared = pairs.groupBy("ids").agg(F.count("*").alias("k")).where("k > 1")
    place = ["doc_id", "_hash", "f", "at"]
    same = F.array_join("own", "\n") if shared.limit(1).count() else F.col("ids")
    found = common.stored(found.select(*place, "first", "n", "h", same.alias("same")), "chunks")
    # contents meet once, to find each one's first place; what goes is then told by places alone
    owners = found.groupBy("f", "h", "same").agg(F.min(F.struct("doc_id", "_hash", "at")).alias("o")).select(
        F.col("o.doc_id").alias("_id"), F.col("o._hash").alias("_of"), F.col("f").alias("_f"), F.col("o.at").alias("_at"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")) & (F.col("f") == F.col("_f")) & (F.col("at") == F.col("_at"))
    return found.select(*place, "first", "n").join(owners, own, "left_anti").distinct()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of the text, and ``chunks_removed``, ``lines_removed``."""
    cut = repeats(docs, id_col, text_col).groupBy("doc_id", "_hash").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))).alias("_cut"), F.count("*").alias("chunks_removed"))
    own, of, id_, gone, count = (common.fresh(docs, name) for name in ("_hash", "_of", "_id", "_cut", "_count"))
    cut = cut.select(F.col("doc_id").alias(id_), F.col("_hash").alias(of), F.col("_cut").alias(gone), F.col("chunks_removed").alias(count))
    rows = docs.withColumn(own, F.xxhash64(text_col))
    rows = rows.join(cut, (F.col(own) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(id_)), "left")
    lines = F.split(text_col, "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n")
    through = [c for c in docs.columns if c.lower() not in ("chunks_removed", "lines_removed")]
    return rows.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in through],
        F.coalesce(F.col(count), F.lit(0)).alias("chunks_removed"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("lines_removed"))


SQL = """
WITH l AS (
  SELECT doc_id, i, len(ls) AS k, ls[i + 1] AS line, CAST('0x' || substr(md5(ls[i + 1]), 1, 8) AS BIGINT) AS h
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(0, len(ls)) AS t(i)
), rolled AS (
  SELECT *, (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 31 + h) % 1000003 AS roll FROM l
), hits AS (
  SELECT doc_id, i, line, f, coalesce(f < 4 AND roll // CAST(pow(2, f) AS BIGINT) % 2 = 0, FALSE) AS hit FROM rolled, range(0, 5) AS t(f)
), nums AS (
  SELECT *, coalesce(sum(CAST(hit AS INT)) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cno FROM hits
), chunks AS (
  SELECT doc_id, f, cno, string_agg(line, chr(10) ORDER BY i) AS chunk FROM nums GROUP BY doc_id, f, cno HAVING count(*) >= 2
  UNION ALL SELECT doc_id, 5, i, line FROM l WHERE len(line) - len(replace(line, ' ', '')) >= 49
), gone AS (
  SELECT doc_id, f, cno FROM chunks QUALIFY row_number() OVER (PARTITION BY f, chunk ORDER BY doc_id, cno) > 1
), lost AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, f, cno, i FROM nums UNION ALL SELECT doc_id, 5, i, i FROM l) JOIN gone USING (doc_id, f, cno)
), n AS (
  SELECT doc_id, count(*) AS chunks_removed FROM gone GROUP BY doc_id
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE lost.i IS NULL), '') AS text,
       coalesce(max(n.chunks_removed), 0) AS chunks_removed, count(lost.i) AS lines_removed
FROM l LEFT JOIN lost USING (doc_id, i) LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@common.query("op2_linechunks", SQL)
def op2(spark, sf_dir):
    return remove(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "chunks_removed", "lines_removed")
