"""Streaming queries: the events file read as a stream with ``availableNow``, results compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from riskspark import corpus
from riskspark.catalog import governance as g
from riskspark.catalog.common import ORACLES, files, query, table
from riskspark.catalog.scan import CREDENTIALS_SQL
from riskspark.operators import governance as gov
from riskspark.operators.findings import run_rules
from riskspark.operators.secrets import credential_hits
from riskspark.plans import jobs
from riskspark.sources import sinks
from riskspark.session import checkpoint_dir
from riskspark.streaming import batches as sb, jobs as st


def work_dir(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(spark, df, mode: str = "append"):
    """Run a stream to its end into parquet and read it back."""
    out = work_dir(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


@query("stream_dedupe", "SELECT count(DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d')) AS hooks FROM events")
def stream_dedupe(spark, sf):
    ev = event_stream(spark, sf).withColumn("hook", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))).select("hook", "ts")
    return drain(spark, st.webhook_dedupe_stream(ev, "hook", late="30 days")).agg(F.count("*").alias("hooks"))


@query("stream_debounce", """
WITH l AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p, max(ts) OVER () AS m FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l),
a AS (SELECT user_id, session, count(*) AS events, max(ts) AS last, max(m) AS m, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM s GROUP BY 1, 2)
SELECT user_id, paths, events FROM a WHERE last + INTERVAL 6 HOUR <= m - INTERVAL 10 MINUTE""")
def stream_debounce(spark, sf):
    """Only sessions the watermark has closed are emitted."""
    ev = event_stream(spark, sf).withColumn("path", F.col("event_type"))
    return drain(spark, st.debounce_stream(ev, ["user_id"], "6 hours")).select("user_id", F.array_join("paths", ",").alias("paths"), "events")


@query("stream_alert_state", """
SELECT event_id, CASE WHEN blocked THEN 'HARD_BLOCK' WHEN was THEN 'CLEAR' END AS type, blocked AND NOT was AS announce FROM (
  SELECT event_id, event_type IN ('error','click') AS blocked, coalesce(lag(event_type IN ('error','click')) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events)""")
def stream_alert_state(spark, sf):
    ev = event_stream(spark, sf).withColumn("blocked", F.col("event_type").isin("error", "click"))
    return drain(spark, st.alert_state_stream(ev, ["user_id"])).select("event_id", "type", "announce")


@query("stream_cooldown", g._anchors_sql("user_id", 21600) + "SELECT event_id, rank = 1 AS emitted FROM w")
def stream_cooldown(spark, sf):
    return drain(spark, st.cooldown_stream(event_stream(spark, sf), ["user_id"], seconds=21600)).select("event_id", "emitted")


@query("stream_rate_limit", g._anchors_sql("event_type", 10800) + "SELECT event_id, CASE WHEN rank > 10 THEN 429 ELSE 200 END::INTEGER AS status FROM w")
def stream_rate_limit(spark, sf):
    return drain(spark, st.rate_limit_stream(event_stream(spark, sf), ["event_type"], seconds=10800)).select("event_id", "status")


@query("stream_free_quota", """
SELECT event_id, used < 10 AS allowed FROM (SELECT event_id, coalesce(sum(CASE WHEN event_type IN ('purchase','click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events)""")
def stream_free_quota(spark, sf):
    ev = event_stream(spark, sf).withColumn("applied", F.col("event_type").isin("purchase", "click"))
    return drain(spark, st.free_quota_stream(ev, ["user_id"])).select("event_id", "allowed")


@query("stream_credit_ledger", """
WITH RECURSIVE e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 ELSE -1 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, event_id, CAST(3 AS BIGINT) AS before, greatest(3 + d, 0) AS after FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, w.after, greatest(w.after + e.d, 0) FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, CAST(before AS BIGINT) AS balance_before FROM w""")
def stream_credit_ledger(spark, sf):
    delta = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 2).otherwise(-1)
    return drain(spark, st.credit_stream(event_stream(spark, sf).withColumn("delta", delta), ["user_id"], 3)).select("event_id", "balance_before")


@query("stream_key_activation", """
WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1)
SELECT e.event_id, CASE WHEN e.user_id % 5 = 4 THEN 'Unauthorized' WHEN e.user_id % 5 = 1 THEN 'Beta License Expired' WHEN e.ts > CASE WHEN e.user_id % 5 = 0 THEN TIMESTAMP '2024-01-20' ELSE f.first + INTERVAL 14 DAY END THEN 'Beta License Expired' END AS error FROM events e JOIN f USING (user_id)""")
def stream_key_activation(spark, sf):
    k = F.col("user_id") % 5
    preset = F.when(k == 0, F.lit("2024-01-20")).when(k == 1, F.lit("2023-12-01")).cast("timestamp")
    ev = event_stream(spark, sf).withColumn("key_string", F.col("user_id").cast("string")).withColumn("known", k != 4).withColumn("preset_us", F.unix_micros(preset))
    return drain(spark, st.key_activation_stream(ev)).select("event_id", "error")


def run_batches(spark, rows, by, out: str, body, parts: int = 3) -> None:
    """Feed rows to a foreachBatch body in micro-batches whose order of arrival is that of ``by`` (0 to parts - 1).

    The rows are made and dealt once.  What has arrived since the last run is one micro-batch, however many files it has.
    """
    dealt = f"{out}/dealt"
    rows.withColumn("_turn", by.cast("int")).write.partitionBy("_turn").parquet(dealt)
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_turn", T.IntegerType())])).parquet(dealt)
    for k in range(parts):
        stored.where(F.col("_turn") == k).drop("_turn").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start().awaitTermination()


def _changed_scan(spark, sf):
    f = files(spark, sf)
    out = work_dir(spark)
    changed = f.where("changed").select("repo_id", "path")
    body = sb.scan_body(out, lambda part: run_rules(part, [credential_hits]), f)
    run_batches(spark, changed, F.pmod(F.xxhash64("path"), F.lit(2)), out, body, 2)
    return out


_CHANGED_SQL = ", ".join(str(k) for k in sorted({k for k, _, x in corpus._rows() if x.path.endswith(".sql")}))


@query("stream_incremental_scan", "SELECT repo_id, path, rule_id, line FROM (" + corpus.truth_sql(["frontend-secret"], extra_where="WHERE d.doc_id % 2 = 0 AND " + CREDENTIALS_SQL) + ")")
def stream_incremental_scan(spark, sf):
    """Changed paths arrive as a stream of two micro-batches; only those files are scanned again."""
    return sb.read(spark, _changed_scan(spark, sf), "findings").select("repo_id", "path", "rule_id", "line")


@query("stream_incremental_rls", f"""
WITH r AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 AND doc_id % {corpus.COUNT} IN ({_CHANGED_SQL}))
SELECT source AS repo_id, 'supabase/migrations/' || doc_id || '_a.sql' AS path, 'public.widgets_' || doc_id AS table_name FROM documents
WHERE doc_id % {corpus.COUNT} = {corpus.index_of('table without rls')} AND source IN (SELECT source FROM r)""")
def stream_incremental_rls(spark, sf):
    """A changed migration has all migrations of its repository checked again."""
    return sb.read(spark, _changed_scan(spark, sf), "missing_rls").select("repo_id", "path", "table_name").distinct()


def _ingested(spark, sf):
    out = work_dir(spark)
    reports = g._reports(spark, sf)
    body = sb.ingest_body(out, g._licenses(spark, sf), g._orgs(spark, sf))
    run_batches(spark, reports, F.pmod("report_id", F.lit(3)), out, body)
    return out


@query("stream_ingest", f"WITH {g.REPORT_SQL} SELECT 'lic' || r.s_suppkey AS license_key_id, count(*) AS rows FROM r JOIN lineitem ON l_orderkey = r.report_id WHERE r.error IS NULL AND r.s_acctbal > 0 GROUP BY ALL")
def stream_ingest(spark, sf):
    """Reports in three micro-batches; telemetry rows, rejects and usage are written under one ledger."""
    return sb.read(spark, _ingested(spark, sf), "rows").groupBy("license_key_id").agg(F.count("*").alias("rows"))


@query("stream_ingest_rejects", f"WITH {g.REPORT_SQL} SELECT report_id, CASE WHEN error IS NOT NULL THEN 400 ELSE 401 END::INTEGER AS http, report_id % 3 AS batch_id FROM r WHERE error IS NOT NULL OR s_suppkey IS NULL OR s_acctbal <= 0")
def stream_ingest_rejects(spark, sf):
    return sb.read(spark, _ingested(spark, sf), "rejects").select("report_id", "http", "batch_id")


@query("stream_ingest_usage", f"WITH {g.REPORT_SQL} SELECT 'lic' || s_suppkey AS license_id, count(*) AS usage_count FROM r WHERE error IS NULL AND s_acctbal > 0 GROUP BY 1")
def stream_ingest_usage(spark, sf):
    """Usage adds up over micro-batches; a batch run twice does not count twice."""
    return sb.usage_totals(spark, _ingested(spark, sf)).select("license_id", F.col("usage_count").cast("bigint").alias("usage_count"))


@query("stream_entitlements", ORACLES["entitlement_upsert"])
def stream_entitlements(spark, sf):
    """Subscription events in three micro-batches by date, each applied to the snapshot before it."""
    out = work_dir(spark)
    ev = gov.subscription_entitlements(g._subscriptions(spark, sf), "prod-solo", "prod-teams")
    lic = g._licenses(spark, sf).select("token_hash", "label", "seats", "status", "tier", "user_id")
    turn = F.when(F.col("ts") < "1994-01-01", 0).when(F.col("ts") < "1997-01-01", 1).otherwise(2)
    run_batches(spark, ev, turn, out, sb.entitlement_body(out, g._users(spark, sf), lic))
    return sb.snapshot(spark, out, "licenses")


_LATE = "WITH e AS (SELECT event_id, ts, event_id % 3 AS b FROM events), m AS (SELECT b, max(ts) AS m FROM e GROUP BY b), w AS (SELECT e.*, (SELECT max(m) FROM m WHERE m.b < e.b) - INTERVAL 5 DAY AS mark FROM e) "


@query("stream_late_rows", _LATE + "SELECT event_id, b AS batch_id, coalesce(ts < mark, false) AS late FROM w")
def stream_late_rows(spark, sf):
    """Rows behind the watermark go to a side table instead of nowhere."""
    out = work_dir(spark)
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run_batches(spark, ev, F.pmod("event_id", F.lit(3)), out, sb.late_body(out, "5 days"))
    rows = [sb.read(spark, out, name).select("event_id", "batch_id", F.lit(late).alias("late")) for name, late in (("rows", False), ("late", True))]
    return rows[0].unionByName(rows[1])


@query("stream_settled", """
WITH l AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p, max(ts) OVER () AS m FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS burst FROM l)
SELECT user_id, event_type AS path, count(*) AS events FROM s GROUP BY user_id, event_type, burst HAVING max(ts) + INTERVAL 6 HOUR <= max(m) - INTERVAL 10 MINUTE""")
def stream_settled(spark, sf):
    """One row per file and burst of writes that the watermark has closed."""
    ev = event_stream(spark, sf).withColumn("path", F.col("event_type"))
    return drain(spark, st.write_settled_stream(ev, ["user_id", "path"], "6 hours")).select("user_id", "path", "events")


@query("stream_emit_alerts", "SELECT event_id, event_type FROM events WHERE event_type IN ('error','click')")
def stream_emit_alerts(spark, sf):
    out = work_dir(spark)
    alerts = event_stream(spark, sf).where(F.col("event_type").isin("error", "click")).select("event_id", "event_type")
    sinks.emit_alerts(alerts, f"{out}/data", f"{out}/ckpt").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "event_type")


# --- batch sinks that write a table ---------------------------------------------------------------------------------

@query("append_telemetry", "SELECT strftime(ts, '%Y-%m-%d') AS day, 2 * count(*) AS rows FROM events GROUP BY 1")
def append_telemetry(spark, sf):
    """Two appends land in day partitions."""
    out = work_dir(spark)
    t = g.telemetry(spark, sf)
    sinks.append_telemetry(t, out)
    sinks.append_telemetry(t, out)
    return spark.read.parquet(out).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"))


@query("append_audit_requests", "SELECT c_custkey, 'new' AS status FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 3 <> 0")
def append_audit_requests(spark, sf):
    out = work_dir(spark)
    k = F.col("c_custkey")
    reqs = table(spark, sf, "customer").select(
        "c_custkey", F.lit("repo").alias("input_type"), F.when(k % 4 < 3, F.col("c_name")).otherwise(" ").alias("target"),
        F.when(k % 3 != 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@x.io"))).otherwise("nobody").alias("email"),
    )
    sinks.append_audit_requests(reqs, out)
    return spark.read.parquet(out).where(F.length("id") == 36).select("c_custkey", "status")


@query("write_sarif", "SELECT repo_id, part, count(*) AS results, min(rank) AS first FROM (SELECT repo_id, CAST((rank - 1) // 2 AS INTEGER) AS part, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line) AS rank FROM (" + corpus.truth_sql(["frontend-secret"], extra_where="WHERE " + CREDENTIALS_SQL) + "))) GROUP BY 1, 2")
def write_sarif(spark, sf):
    """Documents of two results and their manifest, read back."""
    out = work_dir(spark)
    sinks.write_sarif(run_rules(jobs._sources(files(spark, sf)), [credential_hits]), out, per_document=2)
    n = F.size(F.from_json(F.get_json_object("value", "$.runs[0].results"), "array<struct<ruleId:string>>")).cast("bigint")
    docs = spark.read.schema("value string, repo_id string, part int").option("basePath", f"{out}/documents").text(f"{out}/documents").select("repo_id", "part", n.alias("results"))
    said = spark.read.schema("repo_id string, part int, first bigint, results bigint").json(f"{out}/manifest")
    return said.join(docs, ["repo_id", "part", "results"])
