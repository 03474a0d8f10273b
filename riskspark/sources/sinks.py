"""Sinks: SARIF, CI summary, telemetry, audit requests, alerts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark import fixed_values as fv
from riskspark.operators import post
from riskspark.operators.score import ci_tri_state
from riskspark.session import checkpoint

RESULTS_PER_DOCUMENT = 5000


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding: (repo_id, path, line, rule_id, result JSON)."""
    line = F.coalesce(F.nullif("line", F.lit(0)), F.lit(1))
    result = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
            F.array(
                F.struct(
                    F.struct(
                        F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")
                    ).alias("physicalLocation")
                )
            ).alias("locations"),
            F.struct(
                F.col("severity"), F.nullif("evidence", F.lit("")).alias("evidence"), F.nullif("table_name", F.lit("")).alias("tableName")
            ).alias("properties"),
        )
    )
    kept = ["rank"] if "rank" in findings.columns else []
    return findings.select("repo_id", "path", line.alias("line"), "rule_id", *kept, result.alias("result"))


def _driver_json(tool: str) -> str:
    rules = [
        {
            "id": i, "name": name, "shortDescription": {"text": short}, "fullDescription": {"text": full},
            "helpUri": f"https://{tool}.local/rules/{i}", "defaultConfiguration": {"level": level},
            "properties": {"precision": precision, "securitySeverity": score, "tags": tags},
        }
        for i, name, short, full, level, precision, score, tags in fv.SARIF_RULES
    ]
    return json.dumps({"name": tool, "informationUri": f"https://{tool}.local", "rules": rules}, separators=(",", ":"))


def sarif_documents(findings: DataFrame, tool: str = "riskspark", per_document: int = RESULTS_PER_DOCUMENT) -> DataFrame:
    """SARIF 2.1.0 documents: (repo_id, part, first, results, document).

    A repository's results are ranked by path and line and cut into parts of ``per_document``, in order: part k holds the
    results from rank ``first`` = k * per_document + 1 on.  Every repository has this shape, whatever its size.
    """
    ranked = findings if "rank" in findings.columns else post.sort_findings(findings)
    results = sarif_results(ranked).withColumn("part", F.floor((F.col("rank") - 1) / per_document).cast("int"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "result")))  # per_document results at most
    body = results.groupBy("repo_id", "part").agg(
        F.min("rank").alias("first"), F.count("*").alias("results"), F.array_join(F.transform(in_order, lambda r: r["result"]), ",").alias("body"))
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":' + _driver_json(tool) + '},"results":['
    return body.select("repo_id", "part", "first", "results", F.concat(F.lit(head), "body", F.lit("]}]}")).alias("document"))


def write_sarif(findings: DataFrame, path: str, tool: str = "riskspark", mode: str = "overwrite", per_document: int = RESULTS_PER_DOCUMENT) -> None:
    """``<path>/documents/repo_id=…/part=…``: one SARIF document a file; ``<path>/manifest``: (repo_id, part, first, results) as JSON.

    The manifest is written last: a folder with one is whole.
    """
    docs = checkpoint(sarif_documents(findings, tool, per_document))
    docs.select("repo_id", "part", F.col("document").alias("value")).write.mode(mode).partitionBy("repo_id", "part").text(f"{path}/documents")
    docs.select("repo_id", "part", "first", "results").write.mode(mode).json(f"{path}/manifest")


def ci_summary(findings: DataFrame, repos: DataFrame, title: str = "Risk CI Summary", fixes: DataFrame | None = None) -> DataFrame:
    """Markdown per repository: score, count, remediation, first 50 rows by path and line."""
    w = Window.partitionBy("repo_id").orderBy("path", "line", "seq", "rule_id")
    cell = F.concat(
        F.lit("| "), F.coalesce("severity", F.lit("warning")), F.lit(" | `"), F.coalesce("rule_id", F.lit("finding")), F.lit("` | `"), "path", F.lit(":"),
        F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)).cast("string"), F.lit("` | "),
        F.regexp_replace(F.coalesce(F.nullif("message", F.lit("")), F.nullif("evidence", F.lit("")), F.lit("Review required.")), r"\r?\n", " "), F.lit(" |"),
    )
    top = findings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fv.CI_ROWS)
    tables = top.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", cell.alias("c")))), lambda x: x["c"]), "\n").alias("rows")
    )
    counts = findings.groupBy("repo_id").agg(F.count("*").alias("n"))
    base = ci_tri_state(findings, repos).join(counts, "repo_id", "left").join(tables, "repo_id", "left")
    head = "| Severity | Rule | Location | Message |\n| :--- | :--- | :--- | :--- |\n"
    table = F.coalesce(F.concat(F.lit(head), "rows"), F.lit("No findings detected."))
    icon = F.when(F.col("score") == "CONFIRMED FINDING", "🔴 CONFIRMED FINDING (Hard Block)").when(
        F.col("score") == "HIGH-RISK DRIFT", "🟡 HIGH-RISK DRIFT (Needs Runtime Check)").otherwise("🟢 LIKELY SAFE (Trust Receipt)")
    remediation = F.lit("")
    if fixes is not None:
        base = base.join(fixes.select("repo_id", "attempted", "applied", "skipped", "unsupported"), "repo_id", "left")
        lines = [F.concat(F.lit(f"- {c.title()}: "), F.col(c).cast("string"), F.lit("\n")) for c in ("attempted", "applied", "skipped", "unsupported")]
        remediation = F.coalesce(F.concat(F.lit("**Remediation:**\n\n"), *lines, F.lit("\n")), F.lit(""))
    n = F.coalesce("n", F.lit(0))
    text = F.concat(
        F.lit(f"## {title}\n\n**Tri-State Risk Score:** "), icon, F.lit("\n\n**Findings:** "), n.cast("string"), F.lit("\n\n"), remediation, table, F.lit("\n")
    )
    return base.select("repo_id", "score", n.alias("findings"), text.alias("markdown"))


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Append telemetry, partitioned by UTC day."""
    rows.withColumn("id", F.uuid()).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def audit_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with id, status 'new' and created_at; rejected with reason)."""
    error = (
        F.when(~F.coalesce(F.col("input_type").isNotNull() & (F.trim("input_type") != ""), F.lit(False)), "inputType")
        .when(F.coalesce(F.trim("target"), F.lit("")) == "", "target")
        .when(~F.coalesce(F.trim("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), F.lit(False)), "email")
    )
    checked = requests.withColumn("error", error)
    good = checked.where(F.col("error").isNull()).drop("error").withColumn("id", F.uuid()).withColumn("status", F.lit("new")).withColumn(
        "created_at", F.current_timestamp()
    )
    return good, checked.where(F.col("error").isNotNull())


def append_audit_requests(requests: DataFrame, path: str) -> DataFrame:
    good, bad = audit_requests(requests)
    good.write.mode("append").parquet(path)
    return bad


def emit_alerts(alerts: DataFrame, path: str, checkpoint: str, detected: Column | None = None):
    """Streaming sink: alert rows to a table, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if detected is None else detected
        batch.withColumn("detected_at", at).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
