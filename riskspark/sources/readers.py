"""Scans: source trees, migrations, manifests, diffs, rule and policy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.functions import paths as pf
from riskspark.operators import custom, deps, diffs


def read_tree(spark: SparkSession, root: str, repo_id: str | None = None, glob: str | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Every text file below ``root`` as (repo_id, path, ext, content, changed).

    Without ``repo_id`` the first folder below the root names the repository.
    Path filters applied to the result run on file metadata columns, before the
    text is used.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/")
    raw = reader.text(base).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("content"))
    rel = F.element_at(F.split(F.col("file"), "\\Q" + base + "/\\E", 2), -1)
    rows = raw.withColumn("rel", rel)
    if repo_id is None:
        rows = rows.withColumn("repo_id", F.element_at(F.split("rel", "/"), 1)).withColumn("path", F.regexp_replace("rel", "^[^/]*/", ""))
    else:
        rows = rows.withColumn("repo_id", F.lit(repo_id)).withColumn("path", F.col("rel"))
    return rows.select("repo_id", "path", pf.extension(F.col("path")).alias("ext"), "content", F.lit(False).alias("changed"))


def read_source_tree(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """JS/TS sources without declarations, tests and build output."""
    return read_tree(spark, root, repo_id, "*.{js,jsx,ts,tsx}").where(pf.in_source_tree(F.col("path")))


def read_mixed_tree(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """Secret-scan candidates: sources plus env, JSON, YAML, SQL and text files."""
    return read_tree(spark, root, repo_id).where(pf.is_secret_target(F.col("path")) & ~pf.watch_ignored(F.col("path")))


def read_migrations(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    return read_tree(spark, root, repo_id, "*.sql").where(pf.is_migration(F.col("path")))


def read_manifests(spark: SparkSession, root: str, repo_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(dependency rows, quarantine) of every package.json."""
    return deps.parse_manifests(read_tree(spark, root, repo_id, "package.json").where(pf.is_manifest(F.col("path"))))


def read_diffs(spark: SparkSession, root: str) -> DataFrame:
    """Unified diff files as diff lines; the relative file name is the diff id."""
    files = read_tree(spark, root, "diffs", "*.diff")
    return diffs.diff_lines(files.select(F.col("path").alias("diff_id"), F.col("content").alias("diff")))


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(custom rules, rule errors, ignore paths, ignore rules) from JSON policy files (one object per file).

    ``repo_id`` is a field of the file, '*' if absent.  A file that is not JSON
    shows up in the errors.
    """
    schema = (
        "repo_id string, ignorePaths array<string>, ignoreRules array<string>, custom_rules array<" + custom.RAW_RULES + ">, _corrupt string"
    )
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    raw = spark.read.option("wholetext", True).text(path).select(parsed.alias("j")).select("j.*").withColumn("repo_id", F.coalesce("repo_id", F.lit("*")))
    rules, errors = custom.normalize_rules(raw.select("repo_id", F.explode("custom_rules").alias("rule")))
    broken = raw.where(F.col("_corrupt").isNotNull()).select("repo_id", F.lit(None).cast("string").alias("name"), F.lit("invalid JSON").alias("reason"))
    listed = lambda col, name: raw.select("repo_id", F.explode(col).alias(name)).select("repo_id", F.trim(name).alias(name)).where(F.col(name) != "")
    return rules, errors.unionByName(broken), listed("ignorePaths", "pattern"), listed("ignoreRules", "rule_id")


def read_audit_reports(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("report"), "value")
    return deps.audit_counts(raw, "value", "report")
