"""User-defined rules as data: validation, tier gate, targeting, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.functions import paths as pf
from riskspark.operators.findings import finding
from riskspark.operators.modules import call_sites, imports
from riskspark.operators.post import of_repositories

RAW_RULES = (
    "struct<name:string,severity:string,target_files:array<string>,"
    "forbidden_pattern:struct<type:string,import_path:string,object:string,method:string,wrapper:string>>"
)


def normalize_rules(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, errors): raw (repo_id, rule struct) rows validated; each reject carries its reason."""
    r = F.col("rule")
    p = r["forbidden_pattern"]
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    targets = F.filter(F.transform(r["target_files"], F.trim), lambda t: F.coalesce(t, F.lit("")) != "")
    usable = (
        ((p["type"] == "forbidden_import") & text(p["import_path"]).isNotNull())
        | ((p["type"] == "forbidden_method_call") & text(p["method"]).isNotNull())
        | ((p["type"] == "required_wrapper") & text(p["wrapper"]).isNotNull())
    )
    reason = (
        F.when(r.isNull(), "not an object")
        .when(text(r["name"]).isNull(), "name is required")
        .when(~F.coalesce(r["severity"].isin("block", "warn"), F.lit(False)), "severity must be block or warn")
        .when(F.coalesce(F.size(targets), F.lit(0)) <= 0, "target_files is required")
        .when(~F.coalesce(usable, F.lit(False)), "forbidden_pattern is invalid")
    )
    checked = raw.withColumn("reason", reason)
    pattern = F.struct(
        p["type"].alias("type"), text(p["import_path"]).alias("import_path"), text(p["object"]).alias("object"),
        text(p["method"]).alias("method"), text(p["wrapper"]).alias("wrapper"),
    )
    rules = checked.where(F.col("reason").isNull()).select(
        "repo_id", text(r["name"]).alias("name"), r["severity"].alias("severity"), targets.alias("target_files"), pattern.alias("pattern")
    )
    return rules, checked.where(F.col("reason").isNotNull()).select("repo_id", r["name"].alias("name"), "reason")


def gate_rules(rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """Custom rules run only for allowed pro, solo or teams licenses: permissions (repo_id, allowed, tier)."""
    ok = permissions.where(F.col("allowed") & F.col("tier").isin("pro", "solo", "teams")).select("repo_id").distinct()
    return of_repositories(ok, rules).select(rules.columns)


def custom_rule_targets(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path, rule): a rule applies when any of its globs matches the path.

    A repository's rules, and those of '*', are one array, so a path meets one
    policy row and only rules that apply become rows.
    """
    own = of_repositories(files, rules).select("repo_id", F.struct(*[c for c in rules.columns if c != "repo_id"]).alias("r"))
    own = own.groupBy("repo_id").agg(F.collect_list("r").alias("_rules"))
    applies = F.filter("_rules", lambda r: F.exists(r["target_files"], lambda t: pf.matches_target(F.col("path"), t)))
    return files.select("repo_id", "path").join(own, "repo_id").select("repo_id", "path", F.explode(applies).alias("r")).select("repo_id", "path", "r.*").drop("target_files")


def _row(line, evidence):
    return finding(
        rule_id="custom-team-rule", severity=F.when(F.col("severity") == "warn", "warning").otherwise("critical"), line=line,
        message=F.concat(F.lit("Custom team rule violated: "), F.col("name"), F.lit(".")), evidence=evidence,
        custom_rule_name=F.col("name"),
    )


def custom_rule_findings(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Forbidden imports, forbidden calls and missing wrappers of all rules."""
    targets = custom_rule_targets(files, rules)
    kind = F.col("pattern.type")
    imp = (
        targets.where(kind == "forbidden_import").withColumn("source", F.col("pattern.import_path"))
        .join(imports(files).select("repo_id", "path", "source", "line").distinct(), ["repo_id", "path", "source"])
        .select("repo_id", "path", _row(F.col("line"), F.concat(F.lit("forbidden import "), F.col("source"))).alias("f"))
    )
    calls = call_sites(files)
    obj, method = F.col("pattern.object"), F.col("pattern.method")
    tail = F.element_at(F.split("callee", r"\."), -1)
    owned = F.rlike("callee", F.concat(F.lit(r"(?:^|[^\w])\Q"), obj, F.lit(r"\E\.\Q"), method, F.lit(r"\E\z")))
    call = (
        targets.where(kind == "forbidden_method_call").withColumn("tail", F.element_at(F.split(method, r"\."), -1))
        .join(calls.withColumn("tail", tail), ["repo_id", "path", "tail"])
        .where(F.when(obj.isNotNull(), owned).otherwise((F.col("callee") == method) | F.col("callee").endswith(F.concat(F.lit("."), method))))
        .select("repo_id", "path", _row(F.col("line"), F.concat(F.lit("forbidden method call "), F.concat_ws(".", obj, method))).alias("f"))
    )
    wrapped = calls.select("repo_id", "path", F.col("callee").alias("wrapper")).distinct()
    lacking = (
        targets.where(kind == "required_wrapper").withColumn("wrapper", F.regexp_replace("pattern.wrapper", r"\s+", ""))
        .join(wrapped, ["repo_id", "path", "wrapper"], "left_anti")
        .select("repo_id", "path", _row(F.lit(1), F.concat(F.lit("missing required wrapper "), F.col("pattern.wrapper"))).alias("f"))
    )
    return imp.unionByName(call).unionByName(lacking).select("repo_id", "path", "f.*")
