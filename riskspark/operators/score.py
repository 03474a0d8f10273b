"""Scores and roll-ups over findings.  All are plain partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions import paths as pf, scalars as sc
from riskspark import fixed_values as fv


def tri_state(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Per repository: Hard Block, High-Risk Drift or Likely Safe; repositories without findings are safe."""
    state = F.upper(F.coalesce("state", F.lit("")))
    drift_state = state.isin("AMBIGUOUS", "PATCH")
    reasoning = F.col("rule_id") == "llm-reasoning"
    block = (F.col("severity") == "critical") & ~drift_state & ~reasoning
    drift = drift_state | F.col("severity").isin("high", "warning") | reasoning | (F.col("rule_id") == "ambiguous-ast")
    flags = findings.groupBy("repo_id").agg(F.bool_or(block).alias("b"), F.bool_or(drift).alias("d"), F.count("*").alias("n"))
    return repos.select("repo_id").distinct().join(flags, "repo_id", "left").select(
        "repo_id", F.when(F.col("b"), "Hard Block").when(F.col("d"), "High-Risk Drift").otherwise("Likely Safe").alias("score"),
        F.coalesce("n", F.lit(0)).alias("findings"),
    )


def ci_tri_state(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """CI variant: any critical, high or error finding blocks; any other finding is drift."""
    block = F.lower(F.coalesce("severity", F.lit(""))).isin("critical", "high", "error")
    flags = findings.groupBy("repo_id").agg(F.bool_or(block).alias("b"))
    return repos.select("repo_id").distinct().join(flags, "repo_id", "left").select(
        "repo_id", F.when(F.col("b"), "CONFIRMED FINDING").when(F.col("b").isNotNull(), "HIGH-RISK DRIFT").otherwise("LIKELY SAFE").alias("score")
    )


def gate_status(gate: DataFrame, repos: DataFrame) -> DataFrame:
    """HARD_BLOCK > WARNING > PASSED over gate and exploit rows."""
    rank = F.max(F.when(F.col("severity") == "HARD_BLOCK", 2).when(F.col("severity") == "WARNING", 1).otherwise(0))
    top = gate.groupBy("repo_id").agg(rank.alias("r"))
    return repos.select("repo_id").distinct().join(top, "repo_id", "left").select(
        "repo_id", F.when(F.col("r") == 2, "HARD_BLOCK").when(F.col("r") == 1, "WARNING").otherwise("PASSED").alias("status")
    )


def fix_totals(results: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("attempted", "applied", "skipped", "unsupported")]
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("ci_blocked", "reported")]
    return results.groupBy(*keys).agg(*sums, *flags)


def rule_evaluation(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per rule: hits, missed, false positives, precision, recall over distinct (keys, rule)."""
    e = expected.select(*keys, "rule_id").distinct().withColumn("e", F.lit(1))
    f = found.select(*keys, "rule_id").distinct().withColumn("f", F.lit(1))
    j = e.join(f, keys + ["rule_id"], "full_outer")
    hit, miss, extra = (F.count_if(c) for c in (F.col("e").isNotNull() & F.col("f").isNotNull(), F.col("f").isNull(), F.col("e").isNull()))
    agg = j.groupBy("rule_id").agg(hit.alias("hits"), miss.alias("missed"), extra.alias("false_positives"))
    ratio = lambda n, d: F.when(d > 0, F.round(n / d, 6))
    return agg.withColumn("precision", ratio(F.col("hits"), F.col("hits") + F.col("false_positives"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("hits") + F.col("missed"))
    )


def tracked_files(files: DataFrame) -> DataFrame:
    return files.where(~pf.in_dirs(F.col("path"), fv.TRACKED_IGNORED_DIRS)).groupBy("repo_id").agg(F.count("*").alias("files"))


def issue_types_per_file(alerts: DataFrame) -> DataFrame:
    """Distinct issue types per file with a one-line title."""
    types = F.array_sort(F.collect_set("issue_type"))
    agg = alerts.groupBy("repo_id", "path").agg(types.alias("issue_types"), F.count("*").alias("alerts"))
    return agg.withColumn(
        "title", F.when(F.col("alerts") == 1, F.concat(F.lit("HARD BLOCK: "), F.get("issue_types", F.lit(0))))
        .otherwise(F.concat(F.lit("HARD BLOCK: "), F.col("alerts").cast("string"), F.lit(" vulnerabilities")))
    )


def to_alerts(gate: DataFrame, root: Column) -> DataFrame:
    """Gate or exploit rows (issue, severity, source, line, payload, vuln_type, trail) to alert rows."""
    exploit = F.col("payload").isNotNull() & F.col("vuln_type").isNotNull()
    return gate.where(F.col("severity") == "HARD_BLOCK").select(
        "repo_id", F.lit("HARD_BLOCK").alias("type"), sc.absolute_path(root, F.col("path")).alias("path"),
        F.when(exploit, sc.line_from_trail(F.col("trail"))).otherwise(F.col("line")).alias("line"),
        F.when(exploit, F.col("payload")).alias("payload"), F.col("issue").alias("message"),
        F.when(exploit, F.col("vuln_type")).otherwise(F.col("source")).alias("issue_type"),
        F.when(exploit, "fuzzer").otherwise("release-gate").alias("source"),
    )
