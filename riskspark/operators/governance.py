"""Telemetry, organizations, licenses and the 30-day dashboard.

Day boundaries are UTC.  Dashboard operators take a table partitioned by day, so
their date filter prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import scalars as sc
from riskspark.session import checkpoint


# --- dashboard -----------------------------------------------------------------------------

def recent(telemetry: DataFrame, today: Column, days: int = fv.DASHBOARD_DAYS, ts: str = "created_at") -> DataFrame:
    """Rows from the first day of the horizon on, with their dashboard state."""
    start = F.date_sub(today, days - 1)
    return telemetry.where(F.col(ts) >= start.cast("timestamp")).withColumn("board", sc.state_for(F.col("state"), F.col("severity")))


def kpis(board: DataFrame, exact: bool = True, *keys: str) -> DataFrame:
    """Red, yellow, green, intercepts and distinct repositories."""
    repos = F.count_distinct(F.nullif("repo_name", F.lit(""))) if exact else F.approx_count_distinct(F.nullif("repo_name", F.lit("")))
    count = lambda s: F.count_if(F.col("board") == s)
    return board.groupBy(*keys).agg(
        count("RED").alias("red"), count("YELLOW").alias("yellow"), count("GREEN").alias("green"),
        (count("RED") + count("YELLOW")).alias("intercepts"), repos.alias("repos"),
    )


def drift_timeline(board: DataFrame, today: Column, days: int = fv.DASHBOARD_DAYS, ts: str = "created_at") -> DataFrame:
    """One row per day of the horizon, zero filled; GREEN is not counted."""
    spark = board.sparkSession
    dense = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    daily = board.groupBy(F.to_date(ts).alias("day")).agg(
        F.count_if(F.col("board") == "RED").alias("red"), F.count_if(F.col("board") == "YELLOW").alias("yellow")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dense.join(daily, "day", "left").select("day", zero("red"), zero("yellow")).withColumn("total", F.col("red") + F.col("yellow"))


def top_rules(board: DataFrame, limit: int = fv.TOP_RULES, ts: str = "created_at") -> DataFrame:
    """Rules by count, then last seen; GREEN is not counted."""
    agg = board.where(F.col("board") != "GREEN").groupBy("rule_id").agg(
        F.count("*").alias("count"), F.count_if(F.col("board") == "RED").alias("red"),
        F.count_if(F.col("board") == "YELLOW").alias("yellow"), F.max(ts).alias("last_seen"),
    )
    return agg.orderBy(F.desc("count"), F.desc("last_seen"), "rule_id").limit(limit)


def severity_share(board: DataFrame) -> DataFrame:
    """Totals and share per colour; an empty horizon has no share."""
    counted = board.groupBy().agg(*[F.count_if(F.col("board") == s).alias(s) for s in fv.STATES])
    total = F.col("RED") + F.col("YELLOW") + F.col("GREEN")
    slices = F.array(*[F.struct(F.lit(s.title()).alias("name"), F.col(s).alias("value")) for s in fv.STATES])
    return counted.select(total.alias("total"), F.explode(slices).alias("s")).select(
        "s.name", "s.value", "total", F.when(F.col("total") > 0, F.round(F.col("s.value") / F.col("total"), 6)).alias("share")
    )


# --- organizations and licenses ---------------------------------------------------------------

def normalize_repository(rows: DataFrame) -> DataFrame:
    """Add repo_host, repo_owner, repo_name, owner_org from explicit fields or the remote URL."""
    r = F.col("_r")
    return (
        rows.withColumn("_r", sc.parse_remote(F.col("remote_url")))
        .withColumn("repo_host", F.coalesce(sc.blank_to_null(F.col("host")), r["host"]))
        .withColumn("repo_owner", F.coalesce(sc.blank_to_null(F.col("owner")), r["owner"]))
        .withColumn("repo_name", F.coalesce(sc.blank_to_null(F.col("repo")), r["repo"]))
        .withColumn("owner_org", sc.owner_is_org(F.col("is_organization"), F.col("repo_owner"), F.col("personal_owner")))
        .drop("_r")
    )


def org_aliases(orgs: DataFrame) -> DataFrame:
    """(alias, organization_id): every name an owner can be matched on, one row each."""
    raw = orgs.select(
        F.col("id").alias("organization_id"),
        F.explode(F.concat(F.coalesce("github_orgs", F.array()), F.coalesce("gitlab_groups", F.array()), F.array("slug"))).alias("alias"),
    )
    return raw.groupBy("alias").agg(F.min("organization_id").alias("organization_id"))


def org_for_repo(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """Add organization_id by owner: lower-cased or raw, against GitHub orgs, GitLab groups and slug.

    Distinct owners are looked up once and joined back, so a busy owner costs
    one probe.  Rows join by slice as well: those of a busy owner, or without
    one, do not meet in one task; the owners found, which are no more than the
    aliases, stand in every slice.
    """
    slices = 4 * rows.sparkSession.sparkContext.defaultParallelism
    names = org_aliases(orgs)
    owners = rows.where(F.col("repo_owner").isNotNull()).select("repo_owner").distinct()
    tries = owners.withColumn("alias", F.explode(F.array_distinct(F.array(F.lower("repo_owner"), F.col("repo_owner")))))
    found = tries.join(names, "alias").groupBy("repo_owner").agg(F.min("organization_id").alias("organization_id"))
    found = found.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return rows.withColumn("_slice", F.monotonically_increasing_id() % slices).join(found, ["repo_owner", "_slice"], "left").drop("_slice")


def license_for_token(rows: DataFrame, licenses: DataFrame, token: str = "license_key") -> DataFrame:
    """Add the license found by the SHA-256 of the trimmed token."""
    wanted = licenses.select(
        F.col("id").alias("license_id"), "token_hash", F.col("tier").alias("license_tier"), F.col("status").alias("license_status"),
        F.col("organization_id").alias("license_org"), F.col("user_id").alias("license_user"),
    )
    return rows.withColumn("token_hash", F.when(F.trim(token) != "", sc.hash_token(F.col(token)))).join(wanted, "token_hash", "left")


def license_guardrail(rows: DataFrame) -> DataFrame:
    """Add allowed, status, reason.  Needs owner_org, license_tier, license_org, organization_id."""
    solo = F.col("license_tier") == "SOLO"
    foreign = F.col("license_org").isNotNull() & F.col("organization_id").isNotNull() & (F.col("license_org") != F.col("organization_id"))
    reason = (
        F.when(F.col("owner_org") & solo, fv.MSG_ORG_SEAT)
        .when(F.col("owner_org") & ~solo & foreign, fv.MSG_FOREIGN_ORG)
        .otherwise(fv.MSG_LICENSE_OK)
    )
    ok = reason == fv.MSG_LICENSE_OK
    return rows.withColumn("allowed", ok).withColumn("status", F.when(ok, 200).otherwise(403)).withColumn("reason", reason)


def fix_permission(requests: DataFrame) -> DataFrame:
    """Decide fix requests; adds allowed, tier, remaining, message.

    Needs license_key, beta_date (NULL unless a beta key), key_valid, offline,
    tier_hint (configured tier or NULL), validated_tier, owner_org, used.
    Order: no key, beta key, configured tier boundary, validation.
    """
    org, hint = F.col("owner_org"), sc.license_tier(F.col("tier_hint"))
    tier_now = F.coalesce(hint, F.lit("pro"))
    tier_ok = F.coalesce(hint, sc.license_tier(F.col("validated_tier")), F.lit("pro"))
    no_key = F.coalesce(F.trim("license_key"), F.lit("")) == ""
    beta = F.col("beta_date").isNotNull()
    left = F.lit(fv.FREE_FIX_LIMIT) - F.col("used")

    def answer(allowed, tier, message=None, remaining=None):
        as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
        return F.struct(
            as_col(allowed, "boolean").alias("allowed"), as_col(tier, "string").alias("tier"),
            as_col(remaining, "int").alias("remaining"), as_col(message, "string").alias("message"),
        )

    early = org & (tier_now != "teams") & ((tier_now != "solo") | hint.isNotNull())
    decision = (
        F.when(no_key & org, answer(False, "free", fv.MSG_ORG_SEAT))
        .when(no_key & (left > 0), answer(True, "free", None, left))
        .when(no_key, answer(False, "free", fv.MSG_FREE_EXHAUSTED))
        .when(beta & org, answer(False, "pro", fv.MSG_ORG_SEAT))
        .when(beta & ~F.coalesce("key_valid", F.lit(False)), answer(False, "pro", fv.MSG_LICENSE_INVALID))
        .when(beta, answer(True, "pro"))
        .when(early, answer(False, tier_now, fv.MSG_ORG_SEAT))
        .when(F.coalesce("offline", F.lit(False)) & org & (tier_now != "teams"), answer(False, tier_now, fv.MSG_ORG_SEAT))
        .when(F.coalesce("offline", F.lit(False)), answer(True, tier_now))
        .when(~F.coalesce("key_valid", F.lit(False)), answer(False, "pro", fv.MSG_LICENSE_INVALID))
        .when(org & (tier_ok != "teams"), answer(False, tier_ok, fv.MSG_ORG_SEAT))
        .otherwise(answer(True, tier_ok))
    )
    return requests.withColumn("_d", decision).select(*[c for c in requests.columns], "_d.*")


# --- telemetry ---------------------------------------------------------------------------------

def normalize_findings(findings: DataFrame) -> DataFrame:
    """Client payload rows: message and evidence never leave the client."""
    return findings.select(
        "repo_id", F.coalesce(F.nullif("rule_id", F.lit("")), F.lit("unknown")).alias("rule_id"), sc.norm_severity(F.col("severity")).alias("severity"),
        sc.infer_state(F.col("state"), F.col("severity"), F.col("requires_deep")).alias("state"),
        F.coalesce(F.nullif("path", F.lit("")), F.lit("unknown")).alias("file_path"),
    )


_LIMITS = {"rule_id": 160, "severity": 40, "state": 40, "file_path": 600}


def validate_telemetry(reports: DataFrame) -> DataFrame:
    """Add ``error`` to reports (license_key, findings array, source, cli_version, branch, commit_sha, remote_url, host, owner, repo)."""
    n = F.coalesce(F.size("findings"), F.lit(-1))

    def field_bad(f):
        out = F.lit(False)
        for name, limit in _LIMITS.items():
            size = F.coalesce(F.length(F.trim(f[name])), F.lit(0))
            out = out | (size < 1) | (size > limit)
        return out

    too_long = F.lit(False)
    for name, limit in {"cli_version": 80, "branch": 200, "commit_sha": 80, "remote_url": 500, "host": 120, "owner": 160, "repo": 220}.items():
        if name in reports.columns:
            too_long = too_long | (F.coalesce(F.length(F.trim(name)), F.lit(0)) > limit)
    key = F.coalesce(F.length(F.trim("license_key")), F.lit(0))
    error = (
        F.when((key < 1) | (key > 512), "licenseKey")
        .when((n < 1) | (n > 100), "findings")
        .when(F.exists("findings", field_bad), "finding field")
        .when(~F.coalesce("source", F.lit("cli")).isin("cli", "ci", "mcp"), "source")
        .when(too_long, "metadata field")
    )
    return reports.withColumn("error", error)


def ingest_telemetry(reports: DataFrame, licenses: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(telemetry rows, rejected reports, usage per license) of a batch of reports."""
    checked = validate_telemetry(reports)
    bad = checked.where(F.col("error").isNotNull()).withColumn("http", F.lit(400))
    keyed = checkpoint(license_for_token(checked.where(F.col("error").isNull()), licenses))  # three outputs read it
    active = F.coalesce(F.col("license_status") == "ACTIVE", F.lit(False))
    refused = keyed.where(~active).withColumn("http", F.lit(401)).withColumn("error", F.lit("Telemetry requires an active license key."))
    ok = org_for_repo(normalize_repository(keyed.where(active)), orgs)
    rows = ok.select("*", F.explode("findings").alias("f")).select(
        F.coalesce("repo_name", F.lit("unknown")).alias("repo_name"), "repo_owner", F.col("repo_host").alias("remote_host"),
        F.trim("f.rule_id").alias("rule_id"), sc.norm_severity(F.col("f.severity")).alias("severity"), F.trim("f.file_path").alias("file_path"),
        sc.norm_state(F.col("f.state")).alias("state"), F.coalesce("source", F.lit("cli")).alias("source"), "cli_version", "branch", "commit_sha",
        F.col("license_id").alias("license_key_id"), F.coalesce("license_org", "organization_id").alias("organization_id"), "created_at",
    )
    rejected = bad.select("report_id", "http", "error").unionByName(refused.select("report_id", "http", "error"))
    return rows, rejected, usage_counts(ok, "license_id", "created_at")


def usage_counts(uses: DataFrame, key: str, ts: str) -> DataFrame:
    return uses.groupBy(key).agg(F.count("*").alias("usage_count"), F.max(ts).alias("last_used_at"))


def download_totals(events: DataFrame, last_day: Column, ts: str = "ts") -> DataFrame:
    """Downloads of the last day, week and month up to ``last_day``."""
    day = F.to_date(ts)
    within = lambda n: F.count_if((day > F.date_sub(last_day, n)) & (day <= last_day))
    return events.agg(within(1).alias("last_day"), within(7).alias("last_week"), within(30).alias("last_month"))


def download_series(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("downloads"))


# --- subscriptions ---------------------------------------------------------------------------------

def subscription_entitlements(events: DataFrame, solo_id: str, teams_id: str, credits: int = 9999) -> DataFrame:
    """Webhook subscription events to entitlement rows with an ``error`` for unusable ones.

    Needs event_id, ts, subscription_id, status, product_ids array, metadata and
    custom maps, seats, quantity, external_id, customer_email.
    """
    maps = [F.col("metadata"), F.col("custom")]
    tier = sc.sub_tier(F.col("product_ids"), sc.metadata_first(maps, ["tier", "plan", "productTier", "product_tier"]), solo_id, teams_id)
    user = F.coalesce(sc.metadata_first(maps, ["userId", "user_id", "dbUserId", "db_user_id"]), sc.blank_to_null(F.col("external_id")))
    email = F.coalesce(sc.metadata_first(maps, ["email", "userEmail", "user_email"]), sc.blank_to_null(F.col("customer_email")))
    out = events.withColumn("tier", tier).withColumn("user_ref", user).withColumn("email", email)
    error = F.when(F.col("tier").isNull(), "unknown tier").when(F.col("user_ref").isNull() & F.col("email").isNull(), "missing identity")
    return (
        out.withColumn("error", error).withColumn("license_tier", F.upper("tier"))
        .withColumn("seats", sc.sub_seats(F.col("tier"), F.col("seats"), F.col("quantity")))
        .withColumn("license_status", sc.sub_status(F.col("status"))).withColumn("trial_credits", F.lit(credits))
        .withColumn("token_hash", sc.hash_token(F.concat(F.lit("polar:subscription:"), "subscription_id")))
        .withColumn("label", F.concat(F.lit("Polar "), "tier", F.lit(" subscription")))
    )


def webhook_dedupe(events: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Add ``duplicate``: every arrival of an event id after the first."""
    first = events.groupBy(key).agg(F.min_by("arrival", F.struct(ts, "arrival")).alias("_first"))
    return events.join(first, key).withColumn("duplicate", F.col("arrival") != F.col("_first")).drop("_first")


def _lookup(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, of events that hold their order as ``_at``.

    An event without a key matches nothing; it is dealt by its place in the order, as all of them would meet in one task.
    """
    deal = F.when(F.col(key).isNull(), F.xxhash64("_at")).otherwise(F.xxhash64(key))
    return rows.withColumn("_deal", deal).join(found.withColumn("_deal", F.xxhash64(key)), [key, "_deal"], "left").drop("_deal")


def entitlement_upsert(events: DataFrame, users: DataFrame, licenses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, licenses, rejects): snapshots after applying valid entitlement rows, latest per key.

    Rows count in (ts, event_id) order.  A user is matched by id, else created
    with that id and the e-mail; a row without id is matched by e-mail, else
    creates a user.  Users that earlier rows of the batch made are matched too.
    Rows that name nobody, an unknown id without e-mail, or an e-mail that
    another user has, are rejected.
    """
    order = F.struct("ts", "event_id")
    good = events.where(F.col("error").isNull()).withColumn("_at", order)
    by_id = users.select(F.col("id").alias("user_ref"), F.col("id").alias("_by_id"))
    by_mail = users.where(F.col("email").isNotNull()).select("email", F.col("id").alias("_by_mail"))
    matched = _lookup(_lookup(good, by_id, "user_ref"), by_mail, "email")
    # the first row of an unknown id with an e-mail, and the first of an unknown e-mail, claim the e-mail
    fresh = matched.where(F.col("_by_id").isNull() & F.col("email").isNotNull())
    first = fresh.where("user_ref is not null").groupBy("user_ref").agg(F.min_by("email", "_at").alias("email"), F.min_by("_by_mail", "_at").alias("taken"), F.min("_at").alias("_made"))
    mail_only = fresh.where("user_ref is null and _by_mail is null").groupBy("email").agg(F.min("_at").alias("_made")).withColumn("user_ref", F.sha2("email", 256))
    claims = first.where("taken is null").select("email", "user_ref", "_made").unionByName(mail_only)
    owner = claims.groupBy("email").agg(F.min_by("user_ref", "_made").alias("_owner"))
    made = first.where("taken is null").join(owner, "email").where(F.col("user_ref") == F.col("_owner")).select("user_ref", "_made")
    named = _lookup(_lookup(matched, made, "user_ref"), owner, "email")
    named = named.withColumn("user_id", F.coalesce(
        "_by_id", F.when(F.col("user_ref").isNotNull(), F.when(F.col("_at") >= F.col("_made"), F.col("user_ref"))).otherwise(F.coalesce("_by_mail", "_owner"))))
    reason = F.when(F.col("email").isNull(), F.when(F.col("user_ref").isNull(), "no user").otherwise("unknown user without e-mail")).otherwise("e-mail belongs to another user")
    rejects = named.where(F.col("user_id").isNull()).select(*events.columns, reason.alias("reason"))
    resolved = named
    latest_user = resolved.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.struct(F.min_by("email", F.when(F.col("email").isNotNull(), order)).alias("email"), F.max_by("trial_credits", order).alias("trial_credits")).alias("n")
    )
    new_users = users.join(latest_user, users["id"] == latest_user["user_id"], "full_outer").select(
        F.coalesce("id", "user_id").alias("id"), F.coalesce(users["email"], F.col("n.email")).alias("email"),
        F.coalesce(F.col("n.trial_credits"), users["trial_credits"]).alias("trial_credits"),
    )
    cols = ["label", "seats", "license_status", "license_tier", "user_id"]
    latest_license = resolved.where(F.col("user_id").isNotNull()).groupBy("token_hash").agg(F.max_by(F.struct(*cols), order).alias("n"))
    pick = lambda old, new: F.coalesce(F.col(f"n.{new}"), F.col(old)).alias(old)
    new_licenses = licenses.join(latest_license, "token_hash", "full_outer").select(
        "token_hash", pick("label", "label"), pick("seats", "seats"), pick("status", "license_status"), pick("tier", "license_tier"), pick("user_id", "user_id")
    )
    return new_users, new_licenses, rejects
