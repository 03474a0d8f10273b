"""Queries over telemetry, licenses, quotas and time-ordered events.

``events`` stands in for telemetry, requests and alerts: event_type is the rule,
user_id the repository, license or key, value the severity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import fixed_values as fv
from riskspark.catalog.common import events, query, table
from riskspark.functions import scalars as sc
from riskspark.operators import alerts, governance as gov, ordered, score
from riskspark.plans import jobs

TELEMETRY_SQL = """
  t AS (SELECT event_type AS rule_id, ts AS created_at, 'repo' || user_id AS repo_name,
    CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' WHEN value >= 5 THEN 'LOW' ELSE 'INFO' END AS severity,
    CASE event_type WHEN 'error' THEN 'RED' WHEN 'signup' THEN 'YELLOW' ELSE 'GREEN' END AS state FROM events),
  d AS (SELECT CAST(max(ts) AS DATE) AS today FROM events),
  b AS (SELECT t.*, CASE WHEN state = 'RED' OR severity = 'CRITICAL' THEN 'RED' WHEN state = 'YELLOW' OR severity IN ('HIGH','MEDIUM') THEN 'YELLOW' ELSE 'GREEN' END AS board
    FROM t, d WHERE created_at >= d.today - INTERVAL 29 DAY)
"""


def telemetry(spark, sf):
    v = F.col("value")
    sev = F.when(v >= 60, "CRITICAL").when(v >= 30, "HIGH").when(v >= 15, "MEDIUM").when(v >= 5, "LOW").otherwise("INFO")
    state = F.when(F.col("event_type") == "error", "RED").when(F.col("event_type") == "signup", "YELLOW").otherwise("GREEN")
    return events(spark, sf).select(
        F.col("event_type").alias("rule_id"), F.col("ts").alias("created_at"), F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("repo_name"),
        sev.alias("severity"), state.alias("state"),
    )


def _today(spark, sf):
    """The last day of the data: one number, read from parquet statistics-sized aggregation."""
    return F.lit(events(spark, sf).agg(F.to_date(F.max("ts"))).first()[0])


def _board(spark, sf):
    return gov.recent(telemetry(spark, sf), _today(spark, sf))


@query("kpi_counts", f"WITH {TELEMETRY_SQL} SELECT count(*) FILTER (board='RED') AS red, count(*) FILTER (board='YELLOW') AS yellow, count(*) FILTER (board='GREEN') AS green, count(*) FILTER (board IN ('RED','YELLOW')) AS intercepts, count(DISTINCT repo_name) AS repos FROM b")
def kpi_counts(spark, sf):
    return gov.kpis(_board(spark, sf))


@query("drift_timeline", f"WITH {TELEMETRY_SQL}, days AS (SELECT CAST(d.today - CAST(i AS INTEGER) AS DATE) AS day FROM d, range(0, 30) r(i)) SELECT strftime(days.day, '%Y-%m-%d') AS day, count(*) FILTER (board='RED') AS red, count(*) FILTER (board='YELLOW') AS yellow, count(*) FILTER (board IN ('RED','YELLOW')) AS total FROM days LEFT JOIN b ON CAST(b.created_at AS DATE) = days.day GROUP BY days.day")
def drift_timeline(spark, sf):
    return gov.drift_timeline(_board(spark, sf), _today(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("top_rules", f"WITH {TELEMETRY_SQL} SELECT rule_id, count(*) AS \"count\", count(*) FILTER (board='RED') AS red, count(*) FILTER (board='YELLOW') AS yellow, strftime(max(created_at), '%Y-%m-%d') AS last_seen FROM b WHERE board <> 'GREEN' GROUP BY rule_id ORDER BY count(*) DESC, max(created_at) DESC LIMIT 8")
def top_rules(spark, sf):
    return gov.top_rules(_board(spark, sf)).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query("severity_share", f"WITH {TELEMETRY_SQL}, c AS (SELECT count(*) AS total FROM b) SELECT n.name, count(b.board) AS value, c.total, CASE WHEN c.total > 0 THEN round(count(b.board) / c.total, 6) END AS share FROM (VALUES ('Red','RED'),('Yellow','YELLOW'),('Green','GREEN')) n(name, s) CROSS JOIN c LEFT JOIN b ON b.board = n.s GROUP BY n.name, c.total")
def severity_share(spark, sf):
    return gov.severity_share(_board(spark, sf))


@query("governance_dashboard", f"WITH {TELEMETRY_SQL}, a AS (SELECT rule_id, count(*) AS n, max(created_at) AS m FROM b WHERE board <> 'GREEN' GROUP BY rule_id ORDER BY n DESC, m DESC LIMIT 8) SELECT 'rule' AS kind, rule_id AS name, n AS value FROM a UNION ALL SELECT 'colour', board, count(*) FROM b GROUP BY board")
def governance_dashboard(spark, sf):
    parts = jobs.governance_dashboard(telemetry(spark, sf), _today(spark, sf))
    rules = parts["top_rules"].select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), F.col("count").alias("value"))
    colours = parts["severity"].where(F.col("value") > 0).select(F.lit("colour").alias("kind"), F.upper("name").alias("name"), "value")
    return rules.unionByName(colours)


@query("state_mappings", """
SELECT event_id,
  CASE WHEN v < 50 THEN 'MEDIUM' WHEN v < 100 THEN 'CRITICAL' WHEN v < 150 THEN 'HIGH' ELSE 'INFO' END AS severity,
  CASE WHEN event_type = 'error' THEN 'RED' WHEN v >= 50 AND v < 100 THEN 'RED' WHEN v >= 100 AND v < 150 THEN 'YELLOW' ELSE 'GREEN' END AS client_state,
  CASE WHEN event_type = 'error' THEN 'RED' ELSE 'YELLOW' END AS ingest_state
FROM (SELECT *, value AS v FROM events)""")
def state_mappings(spark, sf):
    raw = F.when(F.col("value") < 50, " warn ").when(F.col("value") < 100, "critical").when(F.col("value") < 150, "High").otherwise("odd")
    state = F.when(F.col("event_type") == "error", " red ").otherwise(F.col("event_type"))
    return events(spark, sf).select(
        "event_id", sc.norm_severity(raw).alias("severity"), sc.infer_state(state, raw, F.lit(False)).alias("client_state"), sc.norm_state(state).alias("ingest_state")
    )


@query("normalized_findings", "SELECT 'repo' || user_id AS repo_id, event_type AS rule_id, CASE WHEN value >= 100 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, CASE WHEN value >= 100 THEN 'RED' WHEN event_type = 'error' THEN 'YELLOW' ELSE 'GREEN' END AS state, 'unknown' AS file_path FROM events")
def normalized_findings(spark, sf):
    raw = events(spark, sf).select(
        F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("repo_id"), F.col("event_type").alias("rule_id"),
        F.when(F.col("value") >= 100, "critical").otherwise("warning").alias("severity"), F.lit(None).cast("string").alias("state"),
        (F.col("event_type") == "error").alias("requires_deep"), F.lit("").alias("path"), F.col("props").alias("evidence"),
    )
    return gov.normalize_findings(raw)


@query("download_totals", "WITH d AS (SELECT CAST(max(ts) AS DATE) AS t FROM events) SELECT count(*) FILTER (CAST(ts AS DATE) > t - 1) AS last_day, count(*) FILTER (CAST(ts AS DATE) > t - 7) AS last_week, count(*) FILTER (CAST(ts AS DATE) > t - 30) AS last_month FROM events, d")
def download_totals(spark, sf):
    return gov.download_totals(events(spark, sf), _today(spark, sf))


@query("download_series", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS downloads FROM events GROUP BY 1")
def download_series(spark, sf):
    return gov.download_series(events(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("usage_counts", "SELECT user_id AS license_id, count(*) AS usage_count, epoch_us(max(ts)) AS last_used_us FROM events GROUP BY 1")
def usage_counts(spark, sf):
    out = gov.usage_counts(events(spark, sf).withColumnRenamed("user_id", "license_id"), "license_id", "ts")
    return out.select("license_id", "usage_count", F.unix_micros("last_used_at").alias("last_used_us"))


@query("audit_totals", "SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END)::BIGINT AS high, 0::BIGINT AS info, 0::BIGINT AS low, 0::BIGINT AS moderate, 0::BIGINT AS critical, sum(CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1")
def audit_totals(spark, sf):
    from riskspark.operators import deps

    k = F.get_json_object("props", "$.k")
    raw = F.when(
        F.col("user_id") % 2 == 0,
        F.concat(F.lit('{"metadata":{"vulnerabilities":{"high":'), k, F.lit(',"total":'), F.col("user_id").cast("string"), F.lit("}}}")),
    ).otherwise(F.lit('{"metadata":{}}'))
    reports = events(spark, sf).withColumn("raw", raw)
    return deps.audit_totals(deps.audit_counts(reports, "raw", "event_type"), "event_type")


# --- quotas, cooldowns, keys ---------------------------------------------------------------------

@query("free_quota", """
SELECT event_id, used < 10 AS allowed, CAST(10 - least(used, 10) AS INTEGER) AS remaining FROM (
  SELECT event_id, coalesce(sum(CASE WHEN event_type IN ('purchase','click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events)""")
def free_quota(spark, sf):
    return ordered.free_quota(events(spark, sf), ["user_id"], F.col("event_type").isin("purchase", "click")).select("event_id", "allowed", "remaining")


def _anchors_sql(part: str, width: int) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT event_id, {part} AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {part} ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT k, i, event_id, us, us AS anchor, 1 AS rank FROM e WHERE i = 1
  UNION ALL SELECT e.k, e.i, e.event_id, e.us, CASE WHEN e.us - w.anchor >= {width}000000 THEN e.us ELSE w.anchor END, CASE WHEN e.us - w.anchor >= {width}000000 THEN 1 ELSE w.rank + 1 END
  FROM w JOIN e ON e.k = w.k AND e.i = w.i + 1)
"""


@query("alert_cooldown", _anchors_sql("user_id", 21600) + "SELECT event_id, rank = 1 AS emitted FROM w")
def alert_cooldown(spark, sf):
    """Cooldown stretched to six hours: the data is sparse per user."""
    return ordered.cooldown(events(spark, sf), ["user_id"], seconds=21600).select("event_id", "emitted")


@query("rate_limit", _anchors_sql("event_type", 10800) + "SELECT event_id, CASE WHEN rank > 10 THEN 429 ELSE 200 END::INTEGER AS status, CASE WHEN rank > 10 THEN greatest(1, CAST(ceil((anchor + 10800000000 - us) / 1000000.0) AS INTEGER)) END::INTEGER AS retry_after FROM w")
def rate_limit(spark, sf):
    """Ten requests per key; five hot keys hold all rows."""
    return ordered.rate_limit(events(spark, sf), ["event_type"], seconds=10800).select("event_id", "status", "retry_after")


@query("debounce_batches", """
WITH l AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM s GROUP BY 1, 2""")
def debounce_batches(spark, sf):
    out = ordered.debounce(events(spark, sf), ["user_id"], path="event_type", gap_seconds=12 * 3600)
    return out.select("user_id", "session", "events", F.array_join("paths", ",").alias("paths"))


@query("write_settled", """
WITH l AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM l)
SELECT event_type, CAST(session AS BIGINT) AS session, count(*) AS events, epoch_us(max(ts)) AS last_us FROM s GROUP BY 1, 2""")
def write_settled(spark, sf):
    out = ordered.write_settled(events(spark, sf), ["event_type"], quiet_seconds=1800)
    return out.select("event_type", "session", "events", F.unix_micros("last_ts").alias("last_us"))


@query("credit_ledger", """
WITH RECURSIVE e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 ELSE -1 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, event_id, CAST(3 AS BIGINT) AS before, greatest(3 + d, 0) AS after FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, w.after, greatest(w.after + e.d, 0) FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id, CAST(before AS BIGINT) AS balance_before, before > 0 AS allowed FROM w""")
def credit_ledger(spark, sf):
    delta = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 2).otherwise(-1)
    return ordered.credit_ledger(events(spark, sf), ["user_id"], delta, 3).select("event_id", "balance_before", "allowed")


@query("key_activation", """
WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1),
k AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-20 00:00:00' WHEN 1 THEN TIMESTAMP '2023-12-01 00:00:00' END AS preset FROM customer WHERE c_nationkey <> 7),
s AS (SELECT f.user_id, k.id IS NOT NULL AS known, k.preset < f.first AS refused, CASE WHEN k.preset > f.first THEN k.preset ELSE f.first + INTERVAL 14 DAY END AS expiry FROM f LEFT JOIN k ON k.id = f.user_id)
SELECT e.event_id, CASE WHEN NOT known THEN 'Unauthorized' WHEN coalesce(refused, false) OR e.ts > s.expiry THEN 'Beta License Expired' END AS error FROM events e JOIN s USING (user_id)""")
def key_activation(spark, sf):
    uses = events(spark, sf).withColumn("key_string", F.col("user_id").cast("string"))
    m = F.col("c_custkey") % 4
    records = table(spark, sf, "customer").where(F.col("c_nationkey") != 7).select(
        F.col("c_custkey").cast("string").alias("key_string"), F.lit(None).cast("timestamp").alias("activated_at"),
        F.when(m == 0, F.lit("2024-01-20")).when(m == 1, F.lit("2023-12-01")).cast("timestamp").alias("expires_at"),
    )
    return ordered.key_activation(uses, records).select("event_id", "error")


@query("webhook_dedupe", "SELECT hook, event_id, row_number() OVER (PARTITION BY hook ORDER BY ts, event_id) > 1 AS duplicate FROM (SELECT event_id, ts, 'wh' || user_id || '-' || strftime(ts, '%d') AS hook FROM events)")
def webhook_dedupe(spark, sf):
    ev = events(spark, sf).withColumn("hook", F.concat(F.lit("wh"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "dd")))
    return gov.webhook_dedupe(ev.withColumn("arrival", F.col("event_id")), "hook").select("hook", "event_id", "duplicate")


@query("alert_state", """
SELECT event_id, CASE WHEN blocked THEN 'HARD_BLOCK' WHEN was THEN 'CLEAR' END AS type, blocked AND NOT was AS announce FROM (
  SELECT event_id, event_type IN ('error','click') AS blocked, coalesce(lag(event_type IN ('error','click')) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events)""")
def alert_state(spark, sf):
    scans = events(spark, sf).withColumn("blocked", F.col("event_type").isin("error", "click"))
    return alerts.alert_state(scans, ["user_id"]).select("event_id", "type", "announce")


# --- organizations and licenses -----------------------------------------------------------------------

ORG_SQL = "o AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, lower(n_name) AS slug FROM nation)"


def _orgs(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"),
        F.array(F.concat(F.lower("n_name"), F.lit("-hub"))).alias("github_orgs"), F.array(F.concat(F.lit("Grp"), F.col("n_nationkey").cast("string"))).alias("gitlab_groups"),
    )


def _owned(spark, sf):
    """Customers as repositories: a third each is owned by slug, GitHub alias and GitLab group."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("c_custkey") % 4
    owner = F.when(k == 0, F.initcap("n_name")).when(k == 1, F.concat("n_name", F.lit("-HUB"))).when(k == 2, F.concat(F.lit("Grp"), F.col("c_nationkey").cast("string"))).otherwise("nobody")
    return c.join(n, c.c_nationkey == n.n_nationkey).withColumn("repo_owner", owner)


@query("org_lookup", f"WITH {ORG_SQL} SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN o.id END AS organization_id FROM customer JOIN o ON o.id = CAST(c_nationkey AS VARCHAR)")
def org_lookup(spark, sf):
    return gov.org_for_repo(_owned(spark, sf), _orgs(spark, sf)).select("c_custkey", "organization_id")


def _licenses(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey") % 3
    return s.select(
        F.concat(F.lit("lic"), F.col("s_suppkey").cast("string")).alias("id"), F.sha2(F.col("s_name"), 256).alias("token_hash"),
        F.when(k == 0, "SOLO").when(k == 1, "TEAMS").otherwise("PRO").alias("tier"), F.when(F.col("s_acctbal") > 0, "ACTIVE").otherwise("REVOKED").alias("status"),
        F.when(k == 1, F.col("s_nationkey").cast("string")).alias("organization_id"), F.col("s_suppkey").cast("string").alias("user_id"),
        F.lit("old").alias("label"), F.lit(1).alias("seats"),
    )


@query("license_for_token", "SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN 'lic' || s.s_suppkey END AS license_id, CASE s.s_suppkey % 3 WHEN 0 THEN 'SOLO' WHEN 1 THEN 'TEAMS' WHEN 2 THEN 'PRO' END AS license_tier FROM customer c LEFT JOIN supplier s ON 'Supplier#' || lpad(CAST(c.c_custkey % 200 AS VARCHAR), 9, '0') = s.s_name")
def license_for_token(spark, sf):
    reqs = table(spark, sf, "customer").withColumn("license_key", F.concat(F.lit("  Supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0"), F.lit(" ")))
    return gov.license_for_token(reqs, _licenses(spark, sf)).select("c_custkey", "license_id", "license_tier")


@query("license_guardrail", f"""
SELECT c_custkey, reason = '{fv.MSG_LICENSE_OK}' AS allowed, CASE WHEN reason = '{fv.MSG_LICENSE_OK}' THEN 200 ELSE 403 END::INTEGER AS status, reason FROM (
  SELECT c_custkey, CASE WHEN c_acctbal > 0 AND s.s_suppkey % 3 = 0 THEN '{fv.MSG_ORG_SEAT}'
    WHEN c_acctbal > 0 AND s.s_suppkey % 3 = 1 AND c_custkey % 4 < 3 AND s.s_nationkey <> c_nationkey THEN '{fv.MSG_FOREIGN_ORG}' ELSE '{fv.MSG_LICENSE_OK}' END AS reason
  FROM customer c JOIN supplier s ON 'Supplier#' || lpad(CAST(c.c_custkey % 200 AS VARCHAR), 9, '0') = s.s_name)""")
def license_guardrail(spark, sf):
    reqs = gov.org_for_repo(_owned(spark, sf), _orgs(spark, sf)).withColumn(
        "license_key", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0"))
    ).withColumn("owner_org", F.col("c_acctbal") > 0)
    keyed = gov.license_for_token(reqs, _licenses(spark, sf)).where(F.col("license_id").isNotNull())
    return gov.license_guardrail(keyed).select("c_custkey", "allowed", "status", "reason")


@query("fix_permission", f"""
WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1),
r AS (SELECT c_custkey, c_custkey % 6 AS k, c_acctbal > 4500 AS org, coalesce(u.used, 0) AS used, c_nationkey % 2 = 0 AS valid FROM customer LEFT JOIN u ON u.user_id = c_custkey)
SELECT c_custkey,
  CASE WHEN k = 0 THEN NOT org AND used < 10 WHEN k = 1 THEN NOT org AND valid WHEN k = 2 THEN valid WHEN k = 3 THEN NOT org AND valid WHEN k = 4 THEN NOT org ELSE valid AND NOT org END AS allowed,
  CASE WHEN k = 0 THEN 'free' WHEN k = 1 THEN 'pro' WHEN k = 2 THEN CASE WHEN valid THEN 'teams' ELSE 'pro' END
       WHEN k = 3 THEN CASE WHEN org OR valid THEN 'solo' ELSE 'pro' END WHEN k = 4 THEN 'pro'
       ELSE CASE WHEN org THEN 'pro' WHEN valid THEN 'teams' ELSE 'pro' END END AS tier,
  CASE WHEN k = 0 AND NOT org AND used < 10 THEN CAST(10 - used AS INTEGER) END AS remaining
FROM r""")
def fix_permission(spark, sf):
    """Six request kinds: no key, beta key, teams hint, solo hint, offline, no hint."""
    used = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("used"))
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 6
    reqs = c.join(used, c.c_custkey == used.user_id, "left").select(
        "c_custkey", F.when(k > 0, "key").alias("license_key"), F.when(k == 1, F.lit("2024-01-01")).cast("date").alias("beta_date"),
        ((F.col("c_nationkey") % 2) == 0).alias("key_valid"), (k == 4).alias("offline"),
        F.when(k == 2, "Enterprise seat").when(k == 3, "solo").alias("tier_hint"), F.when(k == 5, "Team plan").alias("validated_tier"),
        (F.col("c_acctbal") > 4500).alias("owner_org"), F.coalesce("used", F.lit(0)).alias("used"),
    )
    return gov.fix_permission(reqs).select("c_custkey", "allowed", "tier", "remaining")


@query("parse_remote", r"""
SELECT page_id, form, CASE WHEN n >= 2 THEN host END AS host, CASE WHEN n >= 2 THEN owner END AS owner, CASE WHEN n >= 2 THEN repo END AS repo FROM (
  SELECT page_id, 'url' AS form, host, segs[1] AS owner, segs[len(segs)] AS repo, len(segs) AS n FROM (
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segs FROM pages)
  UNION ALL SELECT page_id, 'scp', 'git.' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'team' || page_id, 'Repo', 2 FROM pages)""")
def parse_remote(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    scp = F.concat(F.lit(" git@GIT."), host, F.lit(":team"), F.col("page_id").cast("string"), F.lit("/Repo.git"))
    both = pages.select("page_id", F.explode(F.array(F.struct(F.lit("url").alias("form"), F.col("url").alias("u")), F.struct(F.lit("scp").alias("form"), scp.alias("u")))).alias("x"))
    r = sc.parse_remote(F.col("x.u"))
    return both.select("page_id", F.col("x.form").alias("form"), r["host"].alias("host"), r["owner"].alias("owner"), r["repo"].alias("repo"))


@query("repository_owner", """
SELECT c_custkey, c_custkey % 5 = 0 OR (c_custkey % 2 = 0 AND c_nationkey % 3 <> 0) AS owner_org, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 3 <> 0 ELSE c_mktsegment = 'MACHINERY' END AS likely_org FROM customer""")
def repository_owner(spark, sf):
    c = table(spark, sf, "customer")
    owner = F.when(F.col("c_nationkey") % 3 == 0, F.upper("c_name")).when(F.col("c_mktsegment") == "MACHINERY", "acme-labs").otherwise("jane")
    owner = F.when(F.col("c_custkey") % 2 == 0, owner).when(F.col("c_mktsegment") == "MACHINERY", "machinery-team").otherwise("jane")
    personal = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    base = c.select("c_custkey", owner.alias("owner"), personal.alias("personal_owner"), (F.col("c_custkey") % 5 == 0).alias("is_organization"),
                    F.lit(None).cast("string").alias("remote_url"), F.lit(None).cast("string").alias("host"), F.lit("r").alias("repo"))
    return gov.normalize_repository(base).select("c_custkey", "owner_org", sc.looks_like_org(F.col("owner"), F.col("personal_owner")).alias("likely_org"))


@query("license_tier", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'teams' WHEN '2-HIGH' THEN 'solo' WHEN '3-MEDIUM' THEN '3-medium' WHEN '5-LOW' THEN 'solo' ELSE 'pro' END AS tier FROM orders")
def license_tier(spark, sf):
    p = F.col("o_orderpriority")
    first = F.when(p == "1-URGENT", "Acme Enterprise plan").when(p == "2-HIGH", "PRO").when(p == "3-MEDIUM", p).otherwise("  ")
    second = F.when(p == "5-LOW", "single user")
    return table(spark, sf, "orders").select("o_orderkey", sc.first_tier(first, second).alias("tier"))


@query("beta_key_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS created FROM orders")
def beta_key_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    k = F.col("o_orderkey") % 3
    key = F.when(k == 0, F.concat(F.lit(" RISK-BETA-"), day, F.lit("-AB12"))).when(k == 1, F.concat(F.lit("RISK-BETA-"), F.year("o_orderdate").cast("string"), F.lit("0231-X"))).otherwise(
        F.concat(F.lit("RISK-BETA-"), day)
    )
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(sc.beta_key_date(key), "yyyy-MM-dd").alias("created"))


@query("hash_token", "SELECT s_suppkey, sha256(s_name) AS token_hash FROM supplier")
def hash_token(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", sc.hash_token(F.concat(F.lit(" "), F.col("s_name"), F.lit(" "))).alias("token_hash"))


# --- telemetry ingest -------------------------------------------------------------------------------------

def _reports(spark, sf):
    """One report per order; findings are its line items."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    item = F.struct(
        F.concat(F.lit("rule-"), F.col("l_returnflag")).alias("rule_id"), F.when(F.col("l_linestatus") == "O", "warning").otherwise("high").alias("severity"),
        F.when(F.col("l_returnflag") == "R", "red").otherwise("unsure").alias("state"),
        F.when(F.col("l_linenumber") == 7, F.lit(" ")).otherwise(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"))).alias("file_path"),
    )
    items = l.groupBy("l_orderkey").agg(F.collect_list(item).alias("findings"))
    null = F.lit(None).cast("string")
    return o.join(items, o.o_orderkey == items.l_orderkey, "left").select(
        F.col("o_orderkey").alias("report_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 120).cast("string"), 9, "0")).alias("license_key"),
        "findings", F.when(F.col("o_orderstatus") == "P", "bot").when(F.col("o_orderstatus") == "O", "ci").alias("source"), null.alias("cli_version"), null.alias("branch"),
        null.alias("commit_sha"), F.lit("https://Git.example.com/nobody/app.git").alias("remote_url"), null.alias("host"), null.alias("owner"), null.alias("repo"),
        F.lit(None).cast("boolean").alias("is_organization"), null.alias("personal_owner"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


REPORT_SQL = """
i AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber = 7) AS bad FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS report_id, o_orderstatus, n, CASE WHEN n IS NULL OR n > 100 THEN 'findings' WHEN bad THEN 'finding field' WHEN o_orderstatus = 'P' THEN 'source' END AS error,
  s.s_suppkey, s.s_acctbal, s.s_nationkey FROM orders LEFT JOIN i ON i.l_orderkey = o_orderkey LEFT JOIN supplier s ON s.s_name = 'Supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0'))
"""


@query("validate_telemetry", f"WITH {REPORT_SQL} SELECT report_id, error FROM r")
def validate_telemetry(spark, sf):
    return gov.validate_telemetry(_reports(spark, sf)).select("report_id", "error")


@query("ingest_telemetry", f"""WITH {REPORT_SQL} SELECT 'app' AS repo_name, 'nobody' AS repo_owner, 'git.example.com' AS remote_host, 'rule-' || l_returnflag AS rule_id,
  CASE WHEN l_linestatus = 'O' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN l_returnflag = 'R' THEN 'RED' ELSE 'YELLOW' END AS state,
  CASE WHEN r.o_orderstatus = 'O' THEN 'ci' ELSE 'cli' END AS source, 'lic' || r.s_suppkey AS license_key_id, CASE WHEN r.s_suppkey % 3 = 1 THEN CAST(r.s_nationkey AS VARCHAR) END AS organization_id, count(*) AS rows
  FROM r JOIN lineitem ON l_orderkey = r.report_id WHERE r.error IS NULL AND r.s_acctbal > 0 GROUP BY ALL""")
def ingest_telemetry(spark, sf):
    rows, _, _ = gov.ingest_telemetry(_reports(spark, sf), _licenses(spark, sf), _orgs(spark, sf))
    keys = ["repo_name", "repo_owner", "remote_host", "rule_id", "severity", "state", "source", "license_key_id", "organization_id"]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"))


@query("ingest_rejects", f"WITH {REPORT_SQL} SELECT report_id, CASE WHEN error IS NOT NULL THEN 400 ELSE 401 END::INTEGER AS http FROM r WHERE error IS NOT NULL OR s_suppkey IS NULL OR s_acctbal <= 0")
def ingest_rejects(spark, sf):
    _, rejected, _ = gov.ingest_telemetry(_reports(spark, sf), _licenses(spark, sf), _orgs(spark, sf))
    return rejected.select("report_id", "http")


# --- subscriptions --------------------------------------------------------------------------------------------

def _subscriptions(spark, sf):
    k = F.col("o_custkey") % 4
    tier = F.when(k == 0, "Team").when(k == 1, "pro").when(k == 2, "gold")
    none = F.lit(None).cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_custkey").cast("string").alias("subscription_id"),
        F.when(F.col("o_orderstatus") == "F", "canceled").otherwise("active").alias("status"), F.when(k == 3, F.array(F.lit("prod-teams"))).otherwise(F.array(F.lit("x"))).alias("product_ids"),
        F.create_map(F.lit("plan"), tier, F.lit("userId"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string")))).alias("metadata"),
        F.create_map(F.lit("user_email"), F.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("m"), F.col("o_custkey").cast("string"), F.lit("@x.io")))).alias("custom"),
        F.lit(None).cast("int").alias("seats"), F.when(F.col("o_totalprice") > 100000, 5).alias("quantity"), none.alias("external_id"), none.alias("customer_email"),
    )


SUB_SQL = """
s AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_custkey % 4 WHEN 0 THEN 'teams' WHEN 1 THEN 'solo' WHEN 3 THEN 'teams' END AS tier,
  CASE WHEN o_custkey % 3 = 0 THEN 'u' || o_custkey END AS user_ref, CASE WHEN o_custkey % 3 = 1 THEN 'm' || o_custkey || '@x.io' END AS email,
  CASE WHEN o_custkey % 4 = 1 THEN 1 WHEN o_totalprice > 100000 THEN 5 ELSE 1 END AS seats, CASE WHEN o_orderstatus = 'F' THEN 'REVOKED' ELSE 'ACTIVE' END AS status FROM orders),
g AS (SELECT *, CASE WHEN tier IS NULL THEN 'unknown tier' WHEN user_ref IS NULL AND email IS NULL THEN 'missing identity' END AS error FROM s)
"""


@query("subscription_entitlements", f"WITH {SUB_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS event_id, tier, user_ref, email, CAST(seats AS INTEGER) AS seats, status AS license_status, error FROM g WHERE tier IS NOT NULL UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, user_ref, email, CAST(CASE WHEN seats = 5 THEN 5 ELSE 1 END AS INTEGER), status, error FROM g WHERE tier IS NULL")
def subscription_entitlements(spark, sf):
    return gov.subscription_entitlements(_subscriptions(spark, sf), "prod-solo", "prod-teams").select("event_id", "tier", "user_ref", "email", "seats", "license_status", "error")


def _users(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    mine = F.concat(F.lit("u"), k.cast("string"))
    return c.where(k % 2 == 0).select(mine.alias("id"), F.concat(F.lit("m"), k.cast("string"), F.lit("@x.io")).alias("email"), F.lit(0).alias("trial_credits"))


@query("entitlement_upsert", f"""WITH {SUB_SQL}, u AS (SELECT 'u' || c_custkey AS id, 'm' || c_custkey || '@x.io' AS email FROM customer WHERE c_custkey % 2 = 0),
  ok AS (SELECT g.*, coalesce(a.id, CASE WHEN g.user_ref IS NULL THEN b.id END, CASE WHEN g.email IS NOT NULL THEN coalesce(g.user_ref, sha256(g.email)) END) AS uid
    FROM g LEFT JOIN u a ON a.id = g.user_ref LEFT JOIN u b ON b.email = g.email WHERE error IS NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM ok WHERE uid IS NOT NULL)
  SELECT sha256('polar:subscription:' || o_custkey) AS token_hash, 'Polar ' || tier || ' subscription' AS label, CAST(seats AS INTEGER) AS seats, status, upper(tier) AS tier, uid AS user_id FROM r WHERE rn = 1
  UNION ALL SELECT sha256(s_name), 'old', 1, CASE WHEN s_acctbal > 0 THEN 'ACTIVE' ELSE 'REVOKED' END, CASE s_suppkey % 3 WHEN 0 THEN 'SOLO' WHEN 1 THEN 'TEAMS' ELSE 'PRO' END, CAST(s_suppkey AS VARCHAR) FROM supplier""")
def entitlement_upsert(spark, sf):
    ev = gov.subscription_entitlements(_subscriptions(spark, sf), "prod-solo", "prod-teams")
    lic = _licenses(spark, sf).select("token_hash", "label", "seats", "status", "tier", "user_id")
    return gov.entitlement_upsert(ev, _users(spark, sf), lic)[1]


@query("entitlement_users", f"""WITH {SUB_SQL}, u AS (SELECT 'u' || c_custkey AS id, 'm' || c_custkey || '@x.io' AS email FROM customer WHERE c_custkey % 2 = 0),
  ok AS (SELECT coalesce(a.id, CASE WHEN g.user_ref IS NULL THEN b.id END, CASE WHEN g.email IS NOT NULL THEN coalesce(g.user_ref, sha256(g.email)) END) AS uid, g.email
    FROM g LEFT JOIN u a ON a.id = g.user_ref LEFT JOIN u b ON b.email = g.email WHERE error IS NULL),
  n AS (SELECT uid, max(email) AS email FROM ok WHERE uid IS NOT NULL GROUP BY 1)
  SELECT coalesce(u.id, n.uid) AS id, coalesce(u.email, n.email) AS email, CASE WHEN n.uid IS NOT NULL THEN 9999 ELSE 0 END::INTEGER AS trial_credits FROM u FULL JOIN n ON n.uid = u.id""")
def entitlement_users(spark, sf):
    ev = gov.subscription_entitlements(_subscriptions(spark, sf), "prod-solo", "prod-teams")
    return gov.entitlement_upsert(ev, _users(spark, sf), _licenses(spark, sf))[0]


@query("fix_totals", "SELECT l_returnflag AS repo_id, sum(l_quantity)::BIGINT AS attempted, sum(l_linenumber)::BIGINT AS applied, 0::BIGINT AS skipped, 0::BIGINT AS unsupported, bool_or(l_linestatus = 'F') AS ci_blocked, false AS reported FROM lineitem GROUP BY 1")
def fix_totals(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("repo_id"), F.col("l_quantity").cast("bigint").alias("attempted"), F.col("l_linenumber").cast("bigint").alias("applied"),
        F.lit(None).cast("bigint").alias("skipped"), F.lit(None).cast("bigint").alias("unsupported"), (F.col("l_linestatus") == "F").alias("ci_blocked"), F.lit(None).cast("boolean").alias("reported"),
    )
    return score.fix_totals(l, "repo_id")


@query("issue_types_per_file", "SELECT CAST(user_id AS VARCHAR) AS path, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS issue_types, count(*) AS alerts, CASE WHEN count(*) = 1 THEN 'HARD BLOCK: ' || min(event_type) ELSE 'HARD BLOCK: ' || count(*) || ' vulnerabilities' END AS title FROM events GROUP BY user_id")
def issue_types_per_file(spark, sf):
    a = events(spark, sf).select(F.lit("r").alias("repo_id"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("issue_type"))
    return score.issue_types_per_file(a).select("path", F.array_join("issue_types", ",").alias("issue_types"), "alerts", "title")
