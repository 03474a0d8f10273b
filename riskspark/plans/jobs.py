"""Composite jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import lexer, paths as pf
from riskspark.operators import custom, dataflow, deps, diffs, governance, injection as inj, modules, post, remediate, score, secrets, sqlrls
from riskspark.operators.findings import prepare, run_rules, source
from riskspark.session import checkpoint

SOURCE_RULES = [
    secrets.credential_hits, secrets.folded_secrets, secrets.service_role_identifiers, secrets.named_secrets_frontend,
    secrets.service_role_jsx_prop, secrets.jwt_hardcoded, secrets.client_key_args, secrets.database_urls, secrets.named_secrets_backend,
    *inj.INJECTION_RULES,
]

_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_rule(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a file-table -> findings function to every project scan."""
    _REGISTRY[name] = fn


def unregister_rule(name: str) -> None:
    _REGISTRY.pop(name, None)


def registered_findings(files: DataFrame) -> list[DataFrame]:
    return [fn(files) for fn in _REGISTRY.values()]


def _sources(files: DataFrame) -> DataFrame:
    """Source files; the ``ext`` test prunes partitions of a table stored by extension."""
    return files.where(F.col("ext").isin(fv.SOURCE_EXTENSIONS) & pf.in_source_tree(F.col("path")))


def scan_sources(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Row-local rules in one pass, cross-file taint, custom and registered rules."""
    src = _sources(files)
    parts = [run_rules(src, SOURCE_RULES), modules.module_taint(src)]
    if rules is not None:
        parts.append(custom.custom_rule_findings(src, rules))
    return post.union_findings(*parts, *registered_findings(src))


def scan_migrations(files: DataFrame, per_file: bool = False) -> DataFrame:
    sql = files.where(F.lower("ext") == "sql") if per_file else sqlrls.migrations(files)
    missing = sqlrls.missing_rls_per_file(sql) if per_file else sqlrls.missing_rls(sql)
    return post.union_findings(missing, run_rules(sql, [sqlrls.rls_tautology]))


def scan_dependencies(files: DataFrame) -> DataFrame:
    rows, _ = deps.parse_manifests(files.where((F.col("ext") == "json") & pf.is_manifest(F.col("path"))))
    return deps.dependency_unpinned(rows)


def _with_policy(found: DataFrame, ignore_rules: DataFrame | None, ignore_paths: DataFrame | None) -> DataFrame:
    """Findings that the policy leaves; a table that is not given holds nothing."""
    if ignore_rules is None and ignore_paths is None:
        return found.where(~pf.is_test_path(F.col("path")))
    spark = found.sparkSession
    rules = ignore_rules if ignore_rules is not None else spark.createDataFrame([], "repo_id string, rule_id string")
    paths = ignore_paths if ignore_paths is not None else spark.createDataFrame([], "repo_id string, pattern string")
    return post.apply_policy(found, rules, paths)


def scan_project(
    files: DataFrame, ignore_rules: DataFrame | None = None, ignore_paths: DataFrame | None = None,
    rules: DataFrame | None = None, tag: str = "scan-ignore", diff_mode: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(findings, suppressed): all scanners, dedupe, policy, redundancy, suppression.

    ``diff_mode`` checks migrations file by file and leaves manifests out, as a
    scan of changed files does.
    """
    parts = [scan_sources(files, rules), scan_migrations(files, per_file=diff_mode)]
    if not diff_mode:
        parts.append(scan_dependencies(files))
    found = checkpoint(post.dedupe_findings(post.union_findings(*parts)))  # what follows reads it several times
    found = post.drop_redundant_ambiguous(_with_policy(found, ignore_rules, ignore_paths))
    return post.suppress(found, post.directives(files, tag))


def scan_changed(files: DataFrame, changed: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    return scan_project(post.scope_changed(files, changed), diff_mode=True, **kwargs)


def backend_ssrf(files: DataFrame, ignore_rules: DataFrame | None = None, ignore_paths: DataFrame | None = None) -> DataFrame:
    found = run_rules(_sources(files), [inj.ssrf])
    if ignore_rules is None and ignore_paths is None:
        return found
    return _with_policy(checkpoint(found), ignore_rules, ignore_paths)  # the policy's joins read it several times


def secrets_frontend(files: DataFrame) -> DataFrame:
    p = F.col("path")
    scope = pf.is_frontend(p) & ~pf.is_app_api(p) & ~pf.is_pages_api(p) & pf.is_client_component(p, F.col("content"))
    return post.dedupe_findings(run_rules(_sources(files).where(scope), secrets.FRONTEND_RULES))


def secrets_backend(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return post.dedupe_findings(run_rules(_sources(files).where(pf.is_app_api(p) | pf.is_pages_api(p)), secrets.BACKEND_RULES))


def secrets_standalone(files: DataFrame) -> DataFrame:
    both = secrets.FRONTEND_RULES + secrets.BACKEND_RULES
    return post.dedupe_findings(run_rules(_sources(files).where(~pf.is_frontend(F.col("path"))), both))


# --- release gate --------------------------------------------------------------------------------

def gate_code(files: DataFrame) -> DataFrame:
    """Command and account-data rows of the gate: (repo_id, path, line, issue, severity)."""
    f = source()
    rows = F.concat(inj.gate_command_injection(f), inj.gate_bola(f))
    scope = _sources_for_gate(files).where(F.col("content").rlike(inj.GATE_GUARD))
    return prepare(scope, lexer.BLOCKS).select("repo_id", "path", F.explode(rows).alias("g")).select("repo_id", "path", "g.*")


def _sources_for_gate(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(fv.SOURCE_EXTENSIONS) & pf.is_source(F.col("path")) & ~pf.watch_ignored(F.col("path")))


def release_gate(files: DataFrame, tag: str = "scan-ignore") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gate findings, exploit paths, status per repository)."""
    rows, bad = deps.parse_manifests(files.where((F.col("ext") == "json") & pf.is_manifest(F.col("path")) & ~pf.watch_ignored(F.col("path"))))
    fast = gate_code(files).unionByName(deps.gate_dependencies(rows, bad))
    migration = sqlrls.gate_missing_rls(sqlrls.migration_report(sqlrls.migrations(files)))
    gate = checkpoint(post.gate_union(fast, migration))  # the caller and the status read both
    exploits = checkpoint(dataflow.exploit_paths(_sources_for_gate(files), tag))
    both = gate.select("repo_id", "severity").unionByName(exploits.select("repo_id", F.lit("HARD_BLOCK").alias("severity")))
    return gate, exploits, score.gate_status(both, files)


def scan_diffs(diff_table: DataFrame, diff_id: str = "diff_id", text: str = "diff") -> tuple[DataFrame, DataFrame]:
    """(findings, verdict per diff)."""
    added = checkpoint(diffs.added_lines(diffs.diff_lines(diff_table, diff_id, text)))  # six rules read it
    found = checkpoint(diffs.diff_findings(added))
    return found, diffs.diff_verdict(diff_table, found, diff_id)


def governance_dashboard(telemetry: DataFrame, today) -> dict[str, DataFrame]:
    board = governance.recent(telemetry, today)
    return {
        "kpis": governance.kpis(board), "timeline": governance.drift_timeline(board, today),
        "top_rules": governance.top_rules(board), "severity": governance.severity_share(board),
    }


def remediate_files(files: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched files, totals per repository): local fixes of credential and SQL findings."""
    lane = post.fix_lane(F.col("rule_id"), F.col("fix.kind"), F.lit(False))
    marked = findings.withColumn("lane", lane)
    sql = F.col("fix.kind") == "sql-remediation"
    fixes = marked.where(F.col("lane") == "offline").where(F.col("fix.kind") != "scaffold-server-action").select(
        "repo_id", "path", "fix.kind", "fix.start_byte", "fix.end_byte", "fix.expected_text",
        F.when(sql, remediate.parameterize_sql(F.col("fix.raw_snippet"))).otherwise(F.col("fix.replacement")).alias("replacement"),
    )
    patched = checkpoint(remediate.apply_fixes(files, fixes))
    done = patched.groupBy("repo_id").agg(F.sum("attempted").alias("attempted"), F.sum("applied").alias("applied"))
    unfit = marked.groupBy("repo_id").agg(F.count_if(F.col("lane") != "offline").alias("unsupported"))
    totals = unfit.join(done, "repo_id", "left").select(
        "repo_id", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("applied", F.lit(0)).alias("applied"),
        (F.coalesce("attempted", F.lit(0)) - F.coalesce("applied", F.lit(0))).alias("skipped"), "unsupported",
    )
    return patched, totals
