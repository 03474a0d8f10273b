"""Unified diffs: added lines with new-file numbers, per-line and per-file rules, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import scalars as sc
from riskspark.functions.regex import any_of, java

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def diff_lines(diffs: DataFrame, diff_id: str = "diff_id", text: str = "diff") -> DataFrame:
    """(diff_id, seq, file_no, file_path, op, new_line, text) of every diff line.

    Line numbers are running counts inside a hunk: windows over (diff, file,
    hunk), so one large diff is still split by hunk.
    """
    norm = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    raw = diffs.select(F.col(diff_id).alias("diff_id"), F.posexplode(F.split(norm, "\n", -1)).alias("seq", "raw"))
    header = F.regexp_extract("raw", r"^diff --git a/(.+?) b/(.+)\z", 2)
    new_path = F.regexp_extract("raw", r"^\+\+\+ b/(.+)\z", 1)
    start = F.regexp_extract("raw", HUNK, 1)
    by_diff = Window.partitionBy("diff_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = raw.withColumn("header", F.nullif(header, F.lit(""))).withColumn(
        "file_no", F.sum(F.when(F.col("header").isNotNull(), 1).otherwise(0)).over(by_diff)
    )
    by_file = Window.partitionBy("diff_id", "file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    op = (
        F.when(F.col("header").isNotNull(), "header").when(new_path != "", "path").when(start != "", "hunk")
        .when(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"), "+")
        .when(F.col("raw").startswith("-") & ~F.col("raw").startswith("---"), "-")
        .otherwise(" ")
    )
    named = marked.withColumn("op", op).withColumn(
        "file_path", F.coalesce(F.last(F.coalesce(F.nullif(new_path, F.lit("")), F.col("header")), ignorenulls=True).over(by_file), F.lit("unknown"))
    ).withColumn("hunk_no", F.sum(F.when(F.col("op") == "hunk", 1).otherwise(0)).over(by_file)).withColumn(
        "added_no", F.sum(F.when(F.col("op") == "+", 1).otherwise(0)).over(by_file)
    )
    by_hunk = Window.partitionBy("diff_id", "file_no", "hunk_no").orderBy("seq")
    before = by_hunk.rowsBetween(Window.unboundedPreceding, -1)
    first = F.max(F.when(F.col("op") == "hunk", F.regexp_extract("raw", HUNK, 1).try_cast("int"))).over(
        by_hunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    moved = F.coalesce(F.sum(F.when(F.col("op").isin("+", " "), 1).otherwise(0)).over(before), F.lit(0))
    # a start of 0 counts as unset for that line, as does a file without a hunk
    number = F.when(F.col("hunk_no") > 0, F.nullif((first + moved).cast("int"), F.lit(0)))
    return named.withColumn("new_line", F.coalesce(number, F.col("added_no").cast("int"))).select(
        "diff_id", "seq", "file_no", "file_path", "op", "new_line", F.when(F.col("op").isin("+", "-", " "), F.expr("substring(raw, 2)")).otherwise(F.col("raw")).alias("text")
    )


def added_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("op") == "+").select("diff_id", "seq", "file_no", "file_path", F.col("new_line").alias("line"), "text")


def _found(rows: DataFrame, kind, label) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("diff_id", "file_no", "file_path", "line", as_col(kind).alias("kind"), as_col(label).alias("label"))


def diff_secret(added: DataFrame) -> DataFrame:
    """One row per secret occurrence on an added line."""
    occurrences = F.concat(
        *[
            F.array_repeat(F.lit(label), F.size(F.regexp_extract_all("text", F.lit(java(p)), F.lit(0))))
            for _, label, p, _ in fv.DIFF_SECRETS
        ]
    )
    hits = added.where(F.col("text").rlike(any_of([p for _, _, p, _ in fv.DIFF_SECRETS]))).withColumn("label", F.explode(occurrences))
    return _found(hits, "secret", F.col("label"))


def diff_raw_sql(added: DataFrame) -> DataFrame:
    return _found(added.where(F.col("text").rlike(any_of(fv.DIFF_RAW_SQL))), "raw-sql", "Raw SQL concatenation")


def has_tautology(text: Column) -> Column:
    return F.exists(
        F.regexp_extract_all(text, F.lit(java(fv.POLICY_PREDICATE)), F.lit(1)), lambda p: sc.static_predicate(p).isNotNull()
    )


def diff_rls(added: DataFrame) -> DataFrame:
    text = F.col("text")
    all_rows = text.rlike(java(fv.USING_TRUE)) | text.rlike(java(fv.CHECK_TRUE)) | has_tautology(text)
    label = F.when(all_rows, "Supabase policy allows all rows").when(
        text.rlike(java(fv.DIFF_USER_ID_UPDATE)), "Client-controlled user_id update"
    )
    return _found(added.withColumn("label", label).where(F.col("label").isNotNull()), "supabase-rls", F.col("label"))


def diff_middleware_bypass(added: DataFrame) -> DataFrame:
    """Middleware that lets requests through with no guard anywhere in the added text."""
    mid = added.where(F.replace("file_path", F.lit("\\"), F.lit("/")).rlike(java(fv.MIDDLEWARE_PATH)))
    nxt, guard = F.col("text").rlike(java(fv.MIDDLEWARE_NEXT)), F.col("text").rlike(java(fv.MIDDLEWARE_GUARD))
    hit = mid.groupBy("diff_id", "file_no").agg(
        F.max("file_path").alias("file_path"), F.bool_or(nxt).alias("passes"), F.bool_or(guard).alias("guarded"),
        F.min_by("line", F.when(nxt, F.col("seq"))).alias("line"),
    )
    return _found(
        hit.where(F.col("passes") & ~F.col("guarded")), "middleware-auth-bypass",
        "Next.js middleware allows requests through without an auth guard",
    )


def diff_billing_drift(added: DataFrame) -> DataFrame:
    """Webhook path or billing SDK touched without an idempotency word in the added text."""
    touch = F.lower(F.replace("file_path", F.lit("\\"), F.lit("/"))).rlike(java(fv.WEBHOOK_PATH))
    named = F.col("text").rlike(java(fv.BILLING_LINE))
    hit = added.groupBy("diff_id", "file_no").agg(
        F.max("file_path").alias("file_path"), F.bool_or(touch | F.col("text").rlike(java(fv.BILLING_SDK))).alias("billing"),
        F.bool_or(F.col("text").rlike(java(fv.IDEMPOTENCY))).alias("safe"),
        F.coalesce(F.min_by("line", F.when(named, F.col("seq"))), F.min_by("line", "seq")).alias("line"),
    )
    return _found(
        hit.where(F.col("billing") & ~F.col("safe")), "billing-webhook-drift",
        "Billing or webhook code changed without an idempotency guard",
    )


def diff_fuzzy_context(added: DataFrame) -> DataFrame:
    label = sc.first_match(F.col("text"), list(zip(fv.DIFF_FUZZY, fv.DIFF_FUZZY_LABELS)))
    return _found(added.withColumn("label", label).where(F.col("label").isNotNull()), "fuzzy-context", F.col("label"))


def diff_findings(added: DataFrame) -> DataFrame:
    """Confirmed findings; fuzzy ones only for diffs without any confirmed finding."""
    confirmed = diff_secret(added).unionByName(diff_raw_sql(added)).unionByName(diff_rls(added)).unionByName(diff_middleware_bypass(added))
    fuzzy = diff_billing_drift(added).unionByName(diff_fuzzy_context(added))
    quiet = fuzzy.join(confirmed.select("diff_id").distinct(), "diff_id", "left_anti")
    return confirmed.withColumn("confirmed", F.lit(True)).unionByName(quiet.withColumn("confirmed", F.lit(False)))


def diff_verdict(diffs: DataFrame, findings: DataFrame, diff_id: str = "diff_id") -> DataFrame:
    """One state per diff: confirmed-finding, needs-runtime-check or likely-safe."""
    state = findings.groupBy("diff_id").agg(F.bool_or("confirmed").alias("confirmed"), F.count("*").alias("findings"))
    return diffs.select(F.col(diff_id).alias("diff_id")).join(state, "diff_id", "left").select(
        "diff_id",
        F.when(F.col("confirmed"), "confirmed-finding").when(F.col("confirmed").isNotNull(), "needs-runtime-check").otherwise("likely-safe").alias("state"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


def diff_auto_patch(added: DataFrame, tag: str = "") -> DataFrame:
    """-/+ rows that swap a redacted quoted Stripe key for its environment reference."""
    before = sc.redact(F.col("text"), tag)
    stem = fv.DIFF_SECRETS[0][3].format(tag=tag)
    after = F.regexp_replace(before, rf"([\"']){stem}\1", "process.env.STRIPE_SECRET_KEY")
    rows = added.withColumn("before", before).withColumn("after", after).where(F.col("before") != F.col("after"))
    return rows.select("diff_id", "seq", "file_path", "line", F.concat(F.lit("-"), "before").alias("minus"), F.concat(F.lit("+"), "after").alias("plus"))
