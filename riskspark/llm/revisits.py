"""Not-modified revisit resolution for web archive records.

A revisit record holds the headers of a 304 answer and no body.  It is resolved against the latest earlier full response
of the same canonical URL:

* canonical URL: scheme and ``www.`` dropped, host in lower case, default port, fragment, final slash and tracking
  parameters dropped, other parameters sorted;
* as-of: the response before the revisit in (time, record_id); the join is a running last value.  Rows are dealt by
  range of (URL, time, record_id), and what a part ends with is carried into the URL's next parts, so a URL with a third
  of all rows is spread over many tasks;
* validators: entity tags are compared weakly and decide where both sides have one; otherwise Last-Modified must be equal;
* merge: the response's headers, with those that a 304 answer may update taken from the revisit.

Verdicts: ``resolved``, ``mismatch``, ``no_validator`` (nothing to compare), ``no_response`` (nothing earlier).

Cases: a null or empty URL matches nothing; a null time sorts first; repeated rows are resolved each, ties by record_id;
null headers are none; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.llm import common

# Headers that a 304 answer may update, and parameters that do not change what a URL shows.
MAY_UPDATE = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def last_response(records: DataFrame) -> DataFrame:
    """records with ``before``: the latest earlier response of the same ``key`` as struct<record_id, headers>."""
    order = ["ts", "record_id"]
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    rows = records.withColumn("full", full).repartitionByRange("key", *order).withColumn("part", F.spark_partition_id())
    rows = common.stored(rows, "records")
    inside = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("part", "key").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(F.lit(1).alias("some"), *order))).alias("end"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("part").alias("p"), F.col("key").alias("k"), F.last("end", True).over(earlier).alias("carried")).where("carried is not null")
    rows = rows.withColumn("inside", F.last("full", True).over(inside))
    return rows.join(carried, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left").withColumn(
        "before", F.when(F.col("key").isNotNull(), F.coalesce("inside", "carried"))).drop("inside", "carried", "p", "k", "full", "part")


def resolve(records: DataFrame) -> DataFrame:
    """records (record_id, url, ts, kind, headers with lower-case names) -> one row per revisit with its verdict."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "kind", "headers")
    rows = last_response(rows).where("kind = 'revisit'")
    own, old = F.coalesce("headers", F.expr("cast(map() as map<string, string>)")), F.coalesce("before.headers", F.expr("cast(map() as map<string, string>)"))
    rows = rows.select("record_id", "key", "ts", "before", own.alias("own"), old.alias("old"))
    own, old = F.col("own"), F.col("old")
    verdict = (
        F.when(F.col("before").isNull(), "no_response")
        .when(_tag(own).isNotNull() & _tag(old).isNotNull(), F.when(_tag(own) == _tag(old), "resolved").otherwise("mismatch"))
        .when(own["last-modified"].isNotNull() & old["last-modified"].isNotNull(),
              F.when(own["last-modified"] == old["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("no_validator"))
    rows = rows.withColumn("verdict", verdict)
    fresh = F.map_filter(own, lambda k, v: k.isin(MAY_UPDATE) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return rows.select(
        "record_id", "key", "ts", F.col("before.record_id").alias("response_id"), "verdict", F.when(F.col("verdict") == "resolved", merged).alias("headers"))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A full response and a later revisit of every page, as two crawls would leave them.

    Revisits spell the URL otherwise; by page_id they carry the same tag, a weak tag, only the date, another tag, or none;
    one in seven was taken before its page's response.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    second = F.pmod(F.col("page_id") * 7919, F.lit(100_000))
    case = F.pmod("page_id", F.lit(5))
    changed = F.concat(F.lit("day "), F.pmod("page_id", F.lit(97)).cast("string"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", second.alias("ts"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), second.cast("string")).alias("headers"))
    later = F.when(F.pmod("page_id", F.lit(7)) == 0, second - 1).otherwise(second + 50_000)
    url = F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://WWW."), F.when(F.col("url").contains("#"), "x").otherwise("#again"))
    headers = F.map_filter(F.create_map(
        F.lit("etag"), F.when(case == 0, tag).when(case == 1, F.concat(F.lit("W/"), tag)).when(case == 3, F.lit('"other"')),
        F.lit("last-modified"), F.when(case.isin(1, 2), changed),
        F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("expires"), F.lit("never")), lambda k, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), url.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), headers.alias("headers"))
    return response.unionByName(revisit)


SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', '') AS bare, '"' || substr(md5(html), 1, 16) || '"' AS tag,
         page_id * 7919 % 100000 AS s, 'day ' || CAST(page_id % 97 AS VARCHAR) AS changed, octet_length(encode(html)) AS n FROM pages
), q AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params FROM p
), k AS (
  SELECT *, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key FROM q
), r AS (
  SELECT page_id, key, s AS ts, page_id * 2 AS record_id, tag, changed, n FROM k
), v AS (
  SELECT page_id % 5 AS c, tag AS own, changed AS own_changed, key, CASE WHEN page_id % 7 = 0 THEN s - 1 ELSE s + 50000 END AS ts, page_id * 2 + 1 AS record_id FROM k
), m AS (
  SELECT v.*, r.record_id AS response_id, r.tag, r.changed, r.n FROM v LEFT JOIN r ON r.key = v.key AND (r.ts, r.record_id) < (v.ts, v.record_id)
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1
), w AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN c IN (0, 1) THEN CASE WHEN own = tag THEN 'resolved' ELSE 'mismatch' END
    WHEN c = 2 THEN CASE WHEN own_changed = changed THEN 'resolved' ELSE 'mismatch' END WHEN c = 3 THEN 'mismatch' ELSE 'no_validator' END AS verdict FROM m
)
SELECT record_id, key AS url, ts, response_id, verdict, CASE WHEN verdict = 'resolved' THEN
  'content-length: ' || CAST(n AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(ts AS VARCHAR) || chr(10)
  || 'etag: ' || CASE c WHEN 1 THEN 'W/' ELSE '' END || tag || chr(10) || 'expires: never' || chr(10) || 'last-modified: ' || changed END AS headers
FROM w
"""


@common.query("op3_revisits", SQL)
def op3(spark, sf_dir):
    found = resolve(captures(common.table(spark, sf_dir, "pages")))
    return found.select("record_id", F.col("key").alias("url"), "ts", "response_id", "verdict", header_text(F.col("headers")).alias("headers"))
