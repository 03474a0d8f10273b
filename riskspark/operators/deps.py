"""Dependency manifests and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import scalars as sc, text as tx
from riskspark.operators.findings import finding

BLOCKS = ["dependencies", "devDependencies"]


def manifest_text(content: Column) -> Column:
    return F.regexp_replace(content, "^﻿", "")


def parse_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, quarantine): one row per string-valued dependency; bad JSON set aside."""
    text = manifest_text(F.col("content"))
    parsed = F.try_parse_json(text)
    rows = files.withColumn("doc", parsed)
    bad = rows.where(F.col("doc").isNull() | ~F.schema_of_variant("doc").startswith("OBJECT")).select(
        "repo_id", "path", F.lit("invalid JSON").alias("reason")
    )
    good = rows.where(F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT"))

    def block(name):
        members = F.coalesce(
            F.try_variant_get("doc", f"$.{name}", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")
        )
        entries = F.filter(F.map_entries(members), lambda e: F.schema_of_variant(e["value"]) == "STRING")
        return F.transform(
            entries,
            lambda e: F.struct(
                F.lit(name).alias("block"), e["key"].alias("name"), F.try_variant_get(e["value"], "$", "string").alias("version")
            ),
        )

    deps = good.select("repo_id", "path", "content", F.explode(F.concat(*[block(b) for b in BLOCKS])).alias("d"))
    # the line needs the text only for the row at hand, so it is settled before anything shuffles
    offset = F.instr(F.col("content"), F.concat(F.lit('"'), F.col("d.name"), F.lit('"')))
    line = F.when(offset > 0, tx.line_at(F.col("content"), offset - 1)).otherwise(1)
    return deps.select("repo_id", "path", "d.block", "d.name", "d.version", line.cast("int").alias("line")), bad


def dependency_unpinned(deps: DataFrame) -> DataFrame:
    v = F.col("v")
    row = finding(
        rule_id="dependency-unpinned", severity=v["severity"], line=F.col("line"),
        message=F.concat(F.col("block"), F.lit("."), F.col("name"), F.lit(" "), v["issue"]),
        evidence=F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("version"), F.lit('"')),
    )
    return (
        deps.withColumn("v", sc.version_class(F.col("version"))).where(v.isNotNull())
        .select("repo_id", "path", row.alias("f")).select("repo_id", "path", "f.*")
    )


def gate_dependencies(deps: DataFrame, bad: DataFrame) -> DataFrame:
    """Gate rows: unpinned versions, and manifests that cannot be parsed as WARNING."""
    v = F.col("v")
    rows = deps.withColumn("v", sc.version_class(F.col("version"))).where(v.isNotNull()).select(
        "repo_id", "path", F.lit(None).cast("int").alias("line"),
        F.concat(F.col("block"), F.lit("."), F.col("name"), F.lit(" "), v["issue"]).alias("issue"),
        F.when(v["severity"] == "critical", "HARD_BLOCK").otherwise("WARNING").alias("severity"),
    )
    broken = bad.select(
        "repo_id", "path", F.lit(None).cast("int").alias("line"),
        F.concat(F.lit("Could not parse package.json: "), F.col("reason")).alias("issue"), F.lit("WARNING").alias("severity"),
    )
    return rows.unionByName(broken)


AUDIT_LEVELS = ["info", "low", "moderate", "high", "critical", "total"]


def audit_counts(reports: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Audit JSON to severity counts; missing levels are 0."""
    get = lambda n: F.coalesce(F.get_json_object(raw, f"$.metadata.vulnerabilities.{n}").try_cast("bigint"), F.lit(0).cast("bigint"))
    return reports.select(*keys, *[get(n).alias(n) for n in AUDIT_LEVELS])


def audit_totals(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in AUDIT_LEVELS])
