"""Queries over the labelled corpus: rules, migrations, manifests, modules, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import corpus
from riskspark.catalog.common import SHOWN, files, query
from riskspark.functions import paths as pf, scalars as sc, text as tx
from riskspark.operators import custom, dataflow, deps, injection as inj, lexical, modules, post, remediate, score, secrets, sqlrls
from riskspark.operators.findings import only, run_rules
from riskspark.plans import jobs
from riskspark.sources import sinks

NOT_SCANNED = ("redundant",)


def _rule_query(name: str, rules: list, rule_ids: list[str], evidence: str | None = None):
    """One row-local rule over every source file, against the template truth."""
    where = "" if evidence is None else f"WHERE {evidence}"

    @query(name, corpus.truth_sql(rule_ids, extra_where=where))
    def run(spark, sf):
        return run_rules(jobs._sources(files(spark, sf)), rules).select(*SHOWN)

    return run


_LABELS = ("AWS Access Key ID", "Stripe Secret Key", "PostgreSQL Connection URI", r"\bservice[_-]?role[_-]?key\b")
_FOLDED = tuple(corpus.index_of(n) for n in ("concatenated secret", "base64 secret", "joined array secret", "template secret", "shadowed constant", "members of constants"))
_FOLD_SQL = "t.k IN (" + ",".join(map(str, _FOLDED)) + ")"
#: Findings of literals that hold a credential as they stand.
CREDENTIALS_SQL = "t.evidence IN (" + ",".join(corpus._q(x) for x in _LABELS) + f") AND NOT {_FOLD_SQL}"
_rule_query("rule_credentials", [secrets.credential_hits], ["frontend-secret"], CREDENTIALS_SQL)
_rule_query("rule_folded_secrets", [secrets.folded_secrets], ["frontend-secret"], _FOLD_SQL)
_rule_query("rule_service_role_names", [secrets.service_role_identifiers], ["frontend-secret"], "t.evidence = 'Supabase service role reference'")
_rule_query("rule_named_secrets", [secrets.named_secrets_frontend], ["frontend-secret"], "t.evidence LIKE '%assigned a hardcoded literal'")
_rule_query("rule_named_secrets_backend", [secrets.named_secrets_backend], ["backend-secret"], "t.evidence LIKE '%assigned a hardcoded literal'")
_rule_query("rule_jwt_literal", [secrets.jwt_hardcoded], ["backend-secret"], "t.evidence LIKE 'jwt.%'")
_rule_query("rule_client_key_args", [secrets.client_key_args], ["backend-secret"], "t.path LIKE 'app/api/%' AND t.evidence NOT LIKE '%assigned%'")
_rule_query("rule_database_urls", [secrets.database_urls], ["backend-secret"], "t.evidence = 'database connection string'")
_rule_query("rule_admin_client_prop", [secrets.service_role_jsx_prop], ["frontend-secret"], "t.evidence LIKE '%JSX prop'")
_rule_query("rule_ssrf", [inj.ssrf], ["ssrf", "ambiguous-ast"])
_rule_query("rule_sql_injection", [inj.sql_injection], ["sql-injection"])
_rule_query("rule_command_injection", [inj.command_injection], ["command-injection"])
_rule_query("rule_path_traversal", [inj.path_traversal], ["path-traversal"])
_rule_query("rule_auth_bypass", [inj.auth_bypass], ["auth-bypass"])
_rule_query("rule_architectural_leak", [inj.architectural_leak], ["architectural-leak"])
_rule_query("ambiguous_boundaries", [only(inj.ssrf, lambda x: x["rule_id"] == "ambiguous-ast")], ["ambiguous-ast"])


# --- migrations and manifests -------------------------------------------------------------------

def _tables(kind):
    return f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', CAST(d.doc_id AS VARCHAR)) AS path, CAST(t.line + CASE WHEN t.line > 1 THEN d.doc_id % 5 ELSE 0 END AS INTEGER) AS line, replace(t.tab, '{{id}}', CAST(d.doc_id AS VARCHAR)) AS table_name FROM documents d JOIN (VALUES {kind}) AS t(k, path, line, tab) ON d.doc_id % {corpus.COUNT} = t.k"


_A, _B = corpus.index_of("table without rls"), corpus.index_of("rls in another file")
_WITH = corpus.index_of("table with rls")


@query("missing_rls", _tables(f"({_A}, 'supabase/migrations/{{id}}_a.sql', 1, 'public.widgets_{{id}}')"))
def missing_rls(spark, sf):
    return sqlrls.missing_rls(sqlrls.migrations(files(spark, sf))).select("repo_id", "path", "line", "table_name")


@query("missing_rls_per_file", _tables(f"({_A}, 'supabase/migrations/{{id}}_a.sql', 1, 'public.widgets_{{id}}'), ({_B}, 'supabase/migrations/{{id}}_t.sql', 2, 'public.gadgets_{{id}}')"))
def missing_rls_per_file(spark, sf):
    return sqlrls.missing_rls_per_file(sqlrls.migrations(files(spark, sf))).select("repo_id", "path", "line", "table_name")


@query("rls_tautology", corpus.truth_sql(["missing-rls"], extra_where="WHERE t.evidence IS NOT NULL"))
def rls_tautology(spark, sf):
    return run_rules(sqlrls.migrations(files(spark, sf)), [sqlrls.rls_tautology]).select(*SHOWN)


@query("rls_permissive", corpus.gate_truth_sql("WHERE t.severity = 'WARNING' AND t.path LIKE '%.sql'").replace("CAST(t.line + (d.doc_id % 5) AS INTEGER) AS line, ", "").replace(", t.source", ""))
def rls_permissive(spark, sf):
    rows = sqlrls.gate_missing_rls(sqlrls.migration_report(sqlrls.migrations(files(spark, sf))))
    return rows.where(F.col("severity") == "WARNING").select("repo_id", "path", "issue", "severity")


@query("gate_missing_rls", corpus.gate_truth_sql("WHERE t.path LIKE '%.sql'").replace("CAST(t.line + (d.doc_id % 5) AS INTEGER) AS line, ", "").replace(", t.source", ""))
def gate_missing_rls(spark, sf):
    return sqlrls.gate_missing_rls(sqlrls.migration_report(sqlrls.migrations(files(spark, sf)))).select("repo_id", "path", "issue", "severity")


def _sql_facts():
    names = {
        "table without rls": [(0, 1, 1, 0)], "table with rls": [(0, 1, 0, 0)], "rls in another file": [(0, 1, 1, 0), (1, 0, 0, 0)],
        "tautology": [(0, 0, 0, 0)], "permissive policy": [(0, 0, 0, 1)], "commented table": [(0, 1, 1, 0)],
    }
    return ", ".join(f"({corpus.index_of(n)}, {t}, {e}, {w})" for n, rows in names.items() for _, t, e, w in rows)


@query("migration_rollup", f"SELECT d.source AS repo_id, count(*) AS files, sum(t.tables)::BIGINT AS tables, sum(t.errors)::BIGINT AS errors, sum(t.warnings)::BIGINT AS warnings, CASE WHEN sum(t.errors) > 0 THEN 'HARD_BLOCK' WHEN sum(t.warnings) > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM documents d JOIN (VALUES {_sql_facts()}) AS t(k, tables, errors, warnings) ON d.doc_id % {corpus.COUNT} = t.k GROUP BY 1")
def migration_rollup(spark, sf):
    return sqlrls.migration_rollup(sqlrls.migration_report(sqlrls.migrations(files(spark, sf))))


_STATEMENTS = ", ".join(
    f"({corpus.index_of(n)}, {p}, {c})" for n, p, c in (
        ("table without rls", 0, 2), ("table with rls", 0, 2), ("rls in another file", 0, 2), ("rls in another file", 1, 1), ("tautology", 0, 2),
        ("permissive policy", 0, 2), ("commented table", 0, 1),
    )
)


@query("sql_statements", f"SELECT f.path, CAST(t.n + CASE WHEN f.part = 0 THEN 1 ELSE 0 END AS BIGINT) AS statements FROM ({corpus.files_sql(columns='path, k, part')}) f JOIN (VALUES {_STATEMENTS}) AS t(k, part, n) ON t.k = f.k AND t.part = f.part")
def sql_statements(spark, sf):
    """The padding comment after the last ';' counts as a trailing statement."""
    return lexical_count(sqlrls.sql_statements(sqlrls.migrations(files(spark, sf))))


def lexical_count(rows):
    return rows.groupBy("path").agg(F.count("*").alias("statements"))


@query("created_tables", _tables(f"({_A}, 'supabase/migrations/{{id}}_a.sql', 1, 'public.widgets_{{id}}'), ({_B}, 'supabase/migrations/{{id}}_t.sql', 2, 'public.gadgets_{{id}}'), ({_WITH}, 'supabase/migrations/{{id}}_ok.sql', 1, 'public.safe_{{id}}')"))
def created_tables(spark, sf):
    return sqlrls.created_tables(sqlrls.migrations(files(spark, sf))).select("repo_id", "path", "line", "table_name")


@query("dependency_unpinned", corpus.truth_sql(["dependency-unpinned"]))
def dependency_unpinned(spark, sf):
    return jobs.scan_dependencies(files(spark, sf)).select(*SHOWN)


@query("manifest_quarantine", corpus.files_sql(f"k = {corpus.index_of('broken manifest')}", "repo_id, path"))
def manifest_quarantine(spark, sf):
    return deps.parse_manifests(files(spark, sf).where(pf.is_manifest(F.col("path"))))[1].select("repo_id", "path")


# --- modules -------------------------------------------------------------------------------------------

@query("module_taint_violations", corpus.truth_sql(["taint-violation"]))
def module_taint_violations(spark, sf):
    return modules.module_taint(jobs._sources(files(spark, sf))).select(*SHOWN)


_RE, _STAR, _SRV = (corpus.index_of(n) for n in ("re-exported secret", "wildcard secret", "secret stays on server"))


@query("resolve_imports", f"""SELECT d.source AS repo_id, replace(t.importer, '{{id}}', d.doc_id::VARCHAR) AS importer, replace(t.local, '{{id}}', d.doc_id::VARCHAR) AS local, replace(t.src, '{{id}}', d.doc_id::VARCHAR) AS source_path, t.kind
FROM documents d JOIN (VALUES ({_RE}, 'app/widget_{{id}}/page.tsx', 'shared_{{id}}', 'lib/barrel_{{id}}.ts', 'import'), ({_RE}, 'lib/barrel_{{id}}.ts', 'shared_{{id}}', 'lib/vault_{{id}}.ts', 're-export'),
({_STAR}, 'app/star_{{id}}/page.tsx', 'SIGNING_KEY_{{id}}', 'lib/all_{{id}}/index.ts', 'import'), ({_STAR}, 'lib/all_{{id}}/index.ts', '*', 'lib/all_{{id}}/deep_{{id}}.ts', 'export-all'),
({_SRV}, 'app/srv_{{id}}/page.tsx', 'DB_TOKEN_{{id}}', 'lib/srv_{{id}}.ts', 'import')) AS t(k, importer, local, src, kind) ON d.doc_id % {corpus.COUNT} = t.k""")
def resolve_imports(spark, sf):
    return modules.module_edges(jobs._sources(files(spark, sf))).select("repo_id", "importer", "local", "source_path", "kind")


@query("re_exports", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, t.one AS exported_all, CAST(1 + CASE WHEN t.padded = 1 THEN d.doc_id % 5 ELSE d.doc_id % 5 END AS INTEGER) AS line FROM documents d JOIN (VALUES ({_RE}, 'lib/barrel_{{id}}.ts', false, 0), ({_STAR}, 'lib/all_{{id}}/index.ts', true, 0)) AS t(k, path, one, padded) ON d.doc_id % {corpus.COUNT} = t.k")
def re_exports(spark, sf):
    return modules.re_exports(jobs._sources(files(spark, sf))).select("repo_id", "path", (F.col("imported") == "*").alias("exported_all"), "line")


@query("taint_seeds", f"""SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, replace(t.name, '{{id}}', d.doc_id::VARCHAR) AS name FROM documents d JOIN (VALUES
({_RE}, 'lib/vault_{{id}}.ts', 'API_TOKEN_{{id}}'), ({_STAR}, 'lib/all_{{id}}/deep_{{id}}.ts', 'SIGNING_KEY_{{id}}'), ({_SRV}, 'lib/srv_{{id}}.ts', 'DB_TOKEN_{{id}}')) AS t(k, path, name) ON d.doc_id % {corpus.COUNT} = t.k""")
def taint_seeds(spark, sf):
    return modules.taint_seeds(jobs._sources(files(spark, sf)).where(F.col("path").startswith("lib/")))


@query("local_import_sources", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, replace(t.src, '{{id}}', d.doc_id::VARCHAR) AS source FROM documents d JOIN (VALUES ({_RE}, 'app/widget_{{id}}/page.tsx', '../../lib/barrel_{{id}}'), ({_STAR}, 'app/star_{{id}}/page.tsx', '../../lib/all_{{id}}'), ({_SRV}, 'app/srv_{{id}}/page.tsx', '../../lib/srv_{{id}}'), ({corpus.index_of('taint leaves the file')}, 'app/api/amb_{{id}}/route.ts', '../../lib/shape'), ({corpus.index_of('client key imported')}, 'app/api/imp_{{id}}/route.ts', '../../../lib/keys')) AS t(k, path, src) ON d.doc_id % {corpus.COUNT} = t.k")
def local_import_sources(spark, sf):
    return modules.local_import_sources(jobs._sources(files(spark, sf)))


@query("imported_calls", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, t.callee FROM documents d JOIN (VALUES {', '.join(f'({corpus.index_of(n)}, {chr(39)}{p}{chr(39)}, {chr(39)}{c}{chr(39)})' for n, p, c in (('client key literal', 'app/api/sync_{id}/route.ts', 'createClient'), ('client key through object', 'app/api/obj_{id}/route.ts', 'createClient'), ('client key imported', 'app/api/imp_{id}/route.ts', 'createClient'), ('client key from environment', 'app/api/ok_{id}/route.ts', 'createClient'), ('admin client prop', 'app/dash_{id}/page.tsx', 'createClient'), ('validated url fetched', 'app/api/safe_{id}/route.ts', 'validateOutboundUrl'), ('taint leaves the file', 'app/api/amb_{id}/route.ts', 'shape'), ('command built', 'src/ping_{id}.ts', 'exec'), ('forbidden import', 'src/team/legacy_{id}.ts', 'moment')))}) AS t(k, path, callee) ON d.doc_id % {corpus.COUNT} = t.k")
def imported_calls(spark, sf):
    src = jobs._sources(files(spark, sf))
    return modules.callee_is_imported(modules.call_sites(src), modules.imports(src)).select("repo_id", "path", "callee")


_AMB = ", ".join(str(corpus.index_of(n)) for n in ("taint leaves the file", "dynamic dispatch", "ambiguous and precise"))


@query("ambiguous_context", corpus.files_sql(f"k IN ({_AMB})", "repo_id, path"))
def ambiguous_context(spark, sf):
    src = jobs._sources(files(spark, sf))
    return modules.ambiguous_context(run_rules(src, [inj.ssrf]), src)


# --- custom rules -----------------------------------------------------------------------------------------

def _rules(spark, sf):
    """The same four rules for every repository, as rule documents; one is invalid."""
    repos = files(spark, sf).select("repo_id").distinct()
    doc = """[
      {"name":"no-moment","severity":"block","target_files":["src/team/**"],"forbidden_pattern":{"type":"forbidden_import","import_path":"moment"}},
      {"name":"no-console","severity":"warn","target_files":["src/**/*.ts"],"forbidden_pattern":{"type":"forbidden_method_call","object":"console","method":"debug"}},
      {"name":"audited","severity":"block","target_files":["src/handlers/*.ts"],"forbidden_pattern":{"type":"required_wrapper","wrapper":"withAudit"}},
      {"name":"broken","severity":"maybe","target_files":["src"],"forbidden_pattern":{"type":"required_wrapper","wrapper":"x"}}]"""
    raw = repos.select("repo_id", F.explode(F.from_json(F.lit(doc), f"array<{custom.RAW_RULES}>")).alias("rule"))
    return custom.normalize_rules(raw)


_CUSTOM = ", ".join(
    f"({corpus.index_of(n)}, '{p}', '{r}', '{s}', {line}, {sh}, '{e}')" for n, p, r, s, line, sh, e in (
        ("forbidden import", "src/team/legacy_{id}.ts", "no-moment", "critical", 2, 1, "forbidden import moment"),
        ("forbidden call", "src/team/console_{id}.ts", "no-console", "warning", 2, 1, "forbidden method call console.debug"),
        ("unwrapped handler", "src/handlers/bare_{id}.ts", "audited", "critical", 1, 0, "missing required wrapper withAudit"),
    )
)


@query("custom_rules", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, t.rule AS custom_rule_name, t.severity, CAST(t.line + t.sh * (d.doc_id % 5) AS INTEGER) AS line, t.evidence FROM documents d JOIN (VALUES {_CUSTOM}) AS t(k, path, rule, severity, line, sh, evidence) ON d.doc_id % {corpus.COUNT} = t.k")
def custom_rules(spark, sf):
    found = custom.custom_rule_findings(jobs._sources(files(spark, sf)), _rules(spark, sf)[0])
    return found.select("repo_id", "path", "custom_rule_name", "severity", "line", "evidence")


@query("rule_errors", "SELECT DISTINCT source AS repo_id, 'broken' AS name, 'severity must be block or warn' AS reason FROM documents")
def rule_errors(spark, sf):
    return _rules(spark, sf)[1]


@query("custom_rule_targets", f"SELECT repo_id, name, count(*) AS files FROM (SELECT repo_id, path, unnest(list_filter([CASE WHEN path LIKE 'src/team/%' THEN 'no-moment' END, CASE WHEN path LIKE 'src/%/%.ts' THEN 'no-console' END, CASE WHEN path LIKE 'src/handlers/%.ts' THEN 'audited' END], lambda x: x IS NOT NULL)) AS name FROM ({corpus.files_sql(columns='repo_id, path')})) GROUP BY 1, 2")
def custom_rule_targets(spark, sf):
    return custom.custom_rule_targets(files(spark, sf), _rules(spark, sf)[0]).groupBy("repo_id", "name").agg(F.count("*").alias("files"))


@query("gated_rules", "SELECT source AS repo_id, count(DISTINCT doc_id) AS docs, CASE WHEN max(doc_id) % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS rules FROM documents GROUP BY 1")
def gated_rules(spark, sf):
    """Repositories with an odd newest document have a free license, so their rules are dropped."""
    per = files(spark, sf).groupBy("repo_id").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("m"))
    perm = per.select("repo_id", F.lit(True).alias("allowed"), F.when(F.col("m") % 2 == 0, "teams").otherwise("free").alias("tier"))
    kept = custom.gate_rules(_rules(spark, sf)[0], perm).groupBy("repo_id").agg(F.count("*").alias("rules"))
    return per.join(kept, "repo_id", "left").select("repo_id", "docs", F.coalesce("rules", F.lit(0)).alias("rules"))


# --- post-processing -----------------------------------------------------------------------------------------

def _raw(spark, sf):
    return run_rules(jobs._sources(files(spark, sf)), [secrets.named_secrets_frontend, inj.ssrf, inj.sql_injection])


_RAW_WHERE = "WHERE t.rule_id IN ('sql-injection','ssrf','ambiguous-ast') OR t.evidence LIKE '%assigned a hardcoded literal'"
_RAW_RULES = ["frontend-secret", "sql-injection", "ssrf", "ambiguous-ast"]


@query("suppress_findings", corpus.truth_sql(_RAW_RULES, ("suppressed",), extra_where=_RAW_WHERE))
def suppress_findings(spark, sf):
    f = files(spark, sf)
    return post.suppress(_raw(spark, sf), post.directives(f))[0].select(*SHOWN)


@query("suppressed_findings", "SELECT repo_id, path, rule_id, line, line - 1 AS directive_line FROM (" + corpus.truth_sql(None, only_notes=("suppressed",)) + ")")
def suppressed_findings(spark, sf):
    return post.suppress(_raw(spark, sf), post.directives(files(spark, sf)))[1].select("repo_id", "path", "rule_id", "line", "directive_line")


@query("suppression_note", "WITH s AS (" + corpus.truth_sql(None, only_notes=("suppressed",)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line, rule_id) AS rn, count(*) OVER (PARTITION BY repo_id) AS total FROM s) SELECT repo_id, max(total) AS total, string_agg('ignored ' || rule_id || ' at ' || path || ':' || line, chr(10) ORDER BY rn) FILTER (rn <= 5) AS entries, greatest(max(total) - 5, 0) AS more FROM r GROUP BY repo_id")
def suppression_note(spark, sf):
    return post.suppression_note(post.suppress(_raw(spark, sf), post.directives(files(spark, sf)))[1])


@query("drop_redundant", corpus.truth_sql(_RAW_RULES, ("redundant",), extra_where=_RAW_WHERE))
def drop_redundant(spark, sf):
    return post.drop_redundant_ambiguous(_raw(spark, sf)).select(*SHOWN)


@query("dedupe_findings", corpus.truth_sql(_RAW_RULES, extra_where=_RAW_WHERE))
def dedupe_findings(spark, sf):
    """Three copies of every finding; the first survives."""
    raw = _raw(spark, sf)
    copies = raw.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("seq", F.col("seq") * 3 + F.col("copy")).drop("copy")
    return post.dedupe_findings(copies).where(F.col("seq") % 3 == 0).select(*SHOWN)


def _policy(spark, sf):
    repos = files(spark, sf).select("repo_id").distinct()
    rules = repos.withColumn("rule_id", F.lit("ssrf"))
    paths = repos.withColumn("pattern", F.explode(F.array(F.lit("vendor/"), F.lit("src/*carts*"), F.lit("app/api/mix"), F.lit("api/weak"))))
    return rules, paths


@query("policy_filter", "SELECT * FROM (" + corpus.truth_sql([r for r in _RAW_RULES if r != "ssrf"], ("vendor",), extra_where=_RAW_WHERE) + ") WHERE path NOT LIKE 'src/%carts%'")
def policy_filter(spark, sf):
    rules, paths = _policy(spark, sf)
    return post.apply_policy(_raw(spark, sf), rules, paths).select(*SHOWN)


@query("path_ignored", f"SELECT repo_id, path, path LIKE 'vendor/%' OR path LIKE 'src/%carts%' OR path LIKE '%.test.js' OR starts_with(path, 'app/api/mix/') OR contains(path, '/api/weak/') AS ignored FROM ({corpus.files_sql(columns='repo_id, path')})")
def path_ignored(spark, sf):
    return post.path_ignored(files(spark, sf).select("repo_id", "path"), _policy(spark, sf)[1])


@query("changed_files", f"SELECT repo_id, path FROM ({corpus.files_sql()}) WHERE doc_id % 2 = 0 AND regexp_matches(path, '\\.(js|jsx|ts|tsx|sql)$') AND path NOT LIKE 'vendor/%' AND path NOT LIKE 'src/%carts%' AND path NOT LIKE '%.test.js'")
def changed_files(spark, sf):
    f = files(spark, sf)
    names = f.where("changed").select("repo_id", F.concat(F.lit(" "), F.col("path")).alias("path"))
    extra = f.where("changed").select("repo_id", F.concat("path", F.lit(".gone.ts")).alias("path"))
    paths = _policy(spark, sf)[1].where(F.col("pattern").startswith("vendor") | F.col("pattern").startswith("src"))
    return post.changed_files(names, extra, f, paths)


@query("scope_changed", f"SELECT repo_id, path FROM ({corpus.files_sql()}) WHERE doc_id % 2 = 0")
def scope_changed(spark, sf):
    f = files(spark, sf)
    return post.scope_changed(f, f.where("changed").select("repo_id", "path")).select("repo_id", "path")


@query("alert_clears", f"SELECT DISTINCT repo_id, path FROM ({corpus.files_sql()}) WHERE doc_id % 2 = 1")
def alert_clears(spark, sf):
    f = files(spark, sf).select("repo_id", "path", "changed")
    return post.alert_clears(f, f.where("changed"))


@query("tracked_files", f"SELECT repo_id, count(*) AS files FROM ({corpus.files_sql()}) GROUP BY 1")
def tracked_files(spark, sf):
    return score.tracked_files(files(spark, sf))


# --- scores and reports -----------------------------------------------------------------------------------------

_SCAN_TRUTH = corpus.truth_sql(None, ("suppressed", "redundant", "vendor", "per-file"))


def _scan(spark, sf):
    f = files(spark, sf)
    repos = f.select("repo_id").distinct()
    return jobs.scan_project(f, repos.withColumn("rule_id", F.lit("none")), repos.withColumn("pattern", F.lit("vendor/")))


@query("scan_project", _SCAN_TRUTH)
def scan_project(spark, sf):
    return _scan(spark, sf)[0].select(*SHOWN)


_BY_PLACE = "row_number() OVER (PARTITION BY repo_id ORDER BY path, line, rule_id, coalesce(evidence, ''))"


@query("sorted_findings", f"SELECT *, {_BY_PLACE} AS rank FROM ({_SCAN_TRUTH})")
def sorted_findings(spark, sf):
    """The whole scan in order of path and line, ranked over each repository."""
    return post.sort_findings(_scan(spark, sf)[0]).select(*SHOWN, "rank")


@query("scan_changed", corpus.truth_sql([r for r in ("frontend-secret", "backend-secret", "ssrf", "ambiguous-ast", "sql-injection", "command-injection", "path-traversal", "auth-bypass", "architectural-leak", "taint-violation", "missing-rls")], ("suppressed", "redundant"), extra_where="WHERE d.doc_id % 2 = 0"))
def scan_changed(spark, sf):
    f = files(spark, sf)
    return jobs.scan_changed(f, f.where("changed").select("repo_id", "path"))[0].select(*SHOWN)


@query("scan_tri_state", f"WITH s AS ({_SCAN_TRUTH}), r AS (SELECT DISTINCT source AS repo_id FROM documents) SELECT r.repo_id, CASE WHEN bool_or(s.severity = 'critical') THEN 'Hard Block' WHEN count(s.rule_id) > 0 THEN 'High-Risk Drift' ELSE 'Likely Safe' END AS score, count(s.rule_id) AS findings FROM r LEFT JOIN s USING (repo_id) GROUP BY 1")
def scan_tri_state(spark, sf):
    return score.tri_state(_scan(spark, sf)[0], files(spark, sf))


@query("rule_evaluation", f"SELECT rule_id, count(*) AS hits, 0::BIGINT AS missed, 0::BIGINT AS false_positives, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM (SELECT DISTINCT repo_id, path, line, rule_id FROM ({_SCAN_TRUTH})) GROUP BY 1")
def rule_evaluation(spark, sf):
    """Expected findings of the templates against what the scan finds."""
    rows = [(k, f.path, e.rule, e.line, int(e.shifted)) for k, _, f in corpus._rows() for e in f.expects if e.note == ""]
    expect = spark.createDataFrame(rows, "k int, path string, rule_id string, line int, shifted int")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("source").alias("repo_id"))
    want = docs.withColumn("k", F.pmod("doc_id", F.lit(corpus.COUNT)).cast("int")).join(F.broadcast(expect), "k").select(
        "repo_id", F.replace("path", F.lit("{id}"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("line") + F.col("shifted") * F.pmod("doc_id", F.lit(corpus.HEADERS))).cast("int").alias("line"), "rule_id",
    )
    return score.rule_evaluation(want, _scan(spark, sf)[0], ["repo_id", "path", "line"])


def _small_findings(spark, sf):
    return run_rules(jobs._sources(files(spark, sf)), [secrets.credential_hits, inj.sql_injection, inj.command_injection])


_SMALL = corpus.truth_sql(["frontend-secret", "sql-injection", "command-injection"], extra_where=f"WHERE t.rule_id <> 'frontend-secret' OR (t.evidence IN ({','.join(corpus._q(x) for x in _LABELS)}) AND NOT {_FOLD_SQL})")


@query("sarif_rows", f"SELECT repo_id, path AS uri, rule_id, 'error' AS level, line AS start_line, severity, evidence FROM ({_SMALL})")
def sarif_rows(spark, sf):
    r = sinks.sarif_results(_small_findings(spark, sf))
    g = lambda p: F.get_json_object("result", p)
    return r.select(
        "repo_id", g("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), g("$.ruleId").alias("rule_id"), g("$.level").alias("level"),
        g("$.locations[0].physicalLocation.region.startLine").cast("int").alias("start_line"), g("$.properties.severity").alias("severity"), g("$.properties.evidence").alias("evidence"),
    )


@query("sarif_documents", f"""
WITH r AS (SELECT *, {_BY_PLACE} AS rank FROM ({_SMALL}))
SELECT repo_id, CAST((rank - 1) // 3 AS INTEGER) AS part, min(rank) AS first, count(*) AS results, '2.1.0' AS version,
  string_agg(path || ':' || line || ' ' || rule_id, ' | ' ORDER BY rank) AS shown FROM r GROUP BY repo_id, (rank - 1) // 3""")
def sarif_documents(spark, sf):
    """Parts of three results, their results in order."""
    docs = sinks.sarif_documents(_small_findings(spark, sf), per_document=3)
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>"
    results = F.from_json(F.get_json_object("document", "$.runs[0].results"), f"array<struct<ruleId:string,locations:array<{place}>>>")
    at = lambda r: r["locations"][0]["physicalLocation"]
    line = lambda r: F.concat(at(r)["artifactLocation"]["uri"], F.lit(":"), at(r)["region"]["startLine"].cast("string"), F.lit(" "), r["ruleId"])
    return docs.select(
        "repo_id", "part", "first", "results", F.get_json_object("document", "$.version").alias("version"),
        F.array_join(F.transform(results, line), " | ").alias("shown"))


@query("ci_summary", f"""
WITH s AS (SELECT *, {_BY_PLACE} AS rank FROM ({_SMALL})), r AS (SELECT DISTINCT source AS repo_id FROM documents)
SELECT r.repo_id, count(s.rule_id) AS findings, CASE WHEN count(s.rule_id) > 0 THEN 'CONFIRMED FINDING' ELSE 'LIKELY SAFE' END AS score,
  coalesce(string_agg(rule_id || ' ' || path || ':' || line, ' | ' ORDER BY rank) FILTER (WHERE rank <= 50), '') AS shown
FROM r LEFT JOIN s USING (repo_id) GROUP BY 1""")
def ci_summary(spark, sf):
    """The rows that are shown, in their order."""
    out = sinks.ci_summary(_small_findings(spark, sf), files(spark, sf))
    cells = F.transform(F.filter(F.split("markdown", "\n"), lambda l: l.startswith("| critical |")), lambda l: F.split(l, r" \| "))
    shown = F.transform(cells, lambda c: F.concat(F.translate(c[1], "`", ""), F.lit(" "), F.translate(c[2], "`", "")))
    return out.select("repo_id", "findings", "score", F.array_join(shown, " | ").alias("shown"))


# --- gate and graph -------------------------------------------------------------------------------------------------

_JS_GATE = corpus.gate_truth_sql("WHERE t.path NOT LIKE '%.sql' AND t.path NOT LIKE '%.json'").replace(", t.source", "")


@query("gate_code", _JS_GATE)
def gate_code(spark, sf):
    return jobs.gate_code(files(spark, sf)).select("repo_id", "path", "line", "issue", "severity")


@query("gate_dependencies", corpus.gate_truth_sql("WHERE t.path LIKE '%.json'").replace("CAST(t.line + (d.doc_id % 5) AS INTEGER) AS line, ", "").replace(", t.source", ""))
def gate_dependencies(spark, sf):
    rows, bad = deps.parse_manifests(files(spark, sf).where(pf.is_manifest(F.col("path"))))
    return deps.gate_dependencies(rows, bad).select("repo_id", "path", "issue", "severity")


@query("release_gate", corpus.gate_truth_sql())
def release_gate(spark, sf):
    return jobs.release_gate(files(spark, sf))[0].select("repo_id", "path", "line", "issue", "severity", "source")


@query("exploit_paths", corpus.exploit_truth_sql())
def exploit_paths(spark, sf):
    out = dataflow.exploit_paths(jobs._sources_for_gate(files(spark, sf)))
    return out.select("repo_id", "path", "vuln_type", "depth", F.element_at("trail", -1)["text"].alias("sink_text"))


_GATE_REPOS = f"WITH g AS (SELECT repo_id, severity FROM ({corpus.gate_truth_sql()}) UNION ALL SELECT repo_id, 'HARD_BLOCK' FROM ({corpus.exploit_truth_sql()})), r AS (SELECT DISTINCT source AS repo_id FROM documents)"


@query("gate_status", f"{_GATE_REPOS} SELECT r.repo_id, CASE WHEN bool_or(severity = 'HARD_BLOCK') THEN 'HARD_BLOCK' WHEN bool_or(severity = 'WARNING') THEN 'WARNING' ELSE 'PASSED' END AS status FROM r LEFT JOIN g USING (repo_id) GROUP BY 1")
def gate_status(spark, sf):
    return jobs.release_gate(files(spark, sf))[2]


@query("ordered_findings", f"SELECT repo_id, path, severity, CASE severity WHEN 'HARD_BLOCK' THEN 0 ELSE 1 END::INTEGER AS rank FROM ({corpus.gate_truth_sql()})")
def ordered_findings(spark, sf):
    gate = jobs.release_gate(files(spark, sf))[0].withColumn("seq", F.xxhash64("path", "issue"))
    return post.ordered_findings(gate).select("repo_id", "path", "severity", "rank")


@query("route_blocks", f"SELECT d.source AS repo_id, 'src/routes_' || d.doc_id || '.js' AS path, CAST(1 + d.doc_id % 5 AS INTEGER) AS line FROM documents d WHERE d.doc_id % {corpus.COUNT} = {corpus.index_of('route updates account')}")
def route_blocks(spark, sf):
    return jobs._sources(files(spark, sf)).where(F.col("content").contains("router.")).select(
        "repo_id", "path", F.explode(inj.route_blocks(F.col("content"))).alias("b")
    ).select("repo_id", "path", "b.line")


_REQ = ", ".join(
    f"({corpus.index_of(n)}, '{p}', '{v}')" for n, p, v in (
        ("request url fetched", "app/api/proxy_{id}/route.ts", "target"), ("weakly checked url", "app/api/weak_{id}/route.ts", "target"),
        ("command built", "src/ping_{id}.ts", "host"), ("command inline", "src/tar_{id}.js", "name"),
        ("command inline", "src/tar_{id}.js", "alias"), ("command arguments", "src/argv_{id}.js", "host"), ("file read", "src/read_{id}.ts", "name"),
        ("ambiguous and precise", "app/api/mix_{id}/route.ts", "id"),
    )
)


@query("request_variables", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, t.name FROM documents d JOIN (VALUES {_REQ}) AS t(k, path, name) ON d.doc_id % {corpus.COUNT} = t.k")
def request_variables(spark, sf):
    src = jobs._sources(files(spark, sf))
    return src.select("repo_id", "path", F.explode(F.array_distinct(inj.request_vars(F.col("content")))).alias("name"))


# --- jobs over path scopes ----------------------------------------------------------------------------------------------

@query("backend_ssrf", corpus.truth_sql(["ssrf", "ambiguous-ast"]))
def backend_ssrf(spark, sf):
    return jobs.backend_ssrf(files(spark, sf)).select(*SHOWN)


@query("secrets_frontend", corpus.truth_sql(["frontend-secret"], extra_where="WHERE t.path LIKE 'app/dash%' AND t.evidence NOT LIKE '%JSX%'"))
def secrets_frontend(spark, sf):
    return jobs.secrets_frontend(files(spark, sf)).select(*SHOWN)


@query("secrets_backend", corpus.truth_sql(["backend-secret"], extra_where="WHERE t.path LIKE 'app/api/%'"))
def secrets_backend(spark, sf):
    return jobs.secrets_backend(files(spark, sf)).select(*SHOWN)


@query("secrets_standalone", corpus.truth_sql(["frontend-secret", "backend-secret"], extra_where="WHERE t.path NOT LIKE 'app/%'"))
def secrets_standalone(spark, sf):
    return jobs.secrets_standalone(files(spark, sf)).select(*SHOWN)


# --- remediation ----------------------------------------------------------------------------------------------------------

@query("parameterize_sql", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, t.fixed FROM documents d JOIN (VALUES ({corpus.index_of('sql concatenation')}, 'src/repo_{{id}}.ts', '({{ text: \"SELECT * FROM users WHERE id = $1\", values: [id] }})'), ({corpus.index_of('sql chain')}, 'src/carts_{{id}}.ts', '({{ text: \"DELETE FROM carts WHERE id = $1 AND org = $2\", values: [cart, org] }})'), ({corpus.index_of('sql chain')}, 'src/carts_{{id}}.ts', '({{ text: \"DELETE FROM carts WHERE id = $1\", values: [cart] }})'), ({corpus.index_of('ambiguous and precise')}, 'app/api/mix_{{id}}/route.ts', '({{ text: \"SELECT * FROM t WHERE id = $1\", values: [id] }})')) AS t(k, path, fixed) ON d.doc_id % {corpus.COUNT} = t.k")
def parameterize_sql(spark, sf):
    found = run_rules(jobs._sources(files(spark, sf)), [inj.sql_injection])
    return found.select("repo_id", "path", remediate.parameterize_sql(F.col("fix.raw_snippet")).alias("fixed"))


_PATCHED = ", ".join(
    f"({corpus.index_of(n)}, '{p}', {line}, {corpus._q(text)})" for n, p, line, text in (
        ("aws key", "src/aws_{id}.ts", 2, "export const cfg = { id: process.env.AWS_ACCESS_KEY_ID };"), ("stripe key", "src/pay_{id}.ts", 2, "const live = process.env.STRIPE_SECRET_KEY;"),
        ("postgres url", "src/pg_{id}.js", 1, "const dsn = process.env.DATABASE_URL;"), ("named secret", "src/named_{id}.ts", 1, "const sessionToken = process.env.SESSION_TOKEN;"),
        ("non-ascii file", "src/utf_{id}.ts", 2, "/* ключ */ const live = process.env.STRIPE_SECRET_KEY;"),
        ("suppressed secret", "src/quiet_{id}.ts", 2, "const sessionToken = process.env.SESSION_TOKEN;"), ("suppressed secret", "src/quiet_{id}.ts", 3, "const otherToken = process.env.OTHER_TOKEN;"),
        ("vendored secret", "vendor/lib_{id}.ts", 1, "const sessionToken = process.env.SESSION_TOKEN;"), ("crlf file", "src/crlf_{id}.ts", 3, "const live = process.env.STRIPE_SECRET_KEY;"),
        ("backend named secret", "app/api/named_{id}/route.ts", 2, "const apiKey = process.env.API_KEY;"),
        ("key in a substitution", "src/subst_{id}.ts", 1, "const note = `x ${mark(process.env.AWS_ACCESS_KEY_ID)} y`;"),
        ("key below a regular expression", "src/tick_{id}.ts", 4, "export const cfg = { id: process.env.AWS_ACCESS_KEY_ID };"),
    )
)


@query("apply_fixes", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, CAST(t.line + d.doc_id % 5 AS INTEGER) AS line, t.text FROM documents d JOIN (VALUES {_PATCHED}) AS t(k, path, line, text) ON d.doc_id % {corpus.COUNT} = t.k")
def apply_fixes(spark, sf):
    """Credential fixes written back; only the lines that changed are returned."""
    f = jobs._sources(files(spark, sf))
    found = run_rules(f, [secrets.credential_hits, secrets.named_secrets_frontend])
    fixes = remediate.credential_fix(found)
    patched = remediate.apply_fixes(f, fixes).where(F.col("status") == "patched")
    changed = lexical.lines(patched).where(F.col("text").contains("process.env."))
    return changed.select("repo_id", "path", "line", "text")


@query("remediate_totals", f"SELECT d.source AS repo_id, sum(t.n)::BIGINT AS attempted, sum(t.n)::BIGINT AS applied, 0::BIGINT AS skipped FROM documents d JOIN (VALUES {', '.join(f'({corpus.index_of(n)}, {c})' for n, c in (('aws key', 1), ('stripe key', 1), ('postgres url', 1), ('named secret', 1), ('non-ascii file', 1), ('suppressed secret', 2), ('vendored secret', 1), ('crlf file', 1), ('backend named secret', 1), ('key in a substitution', 1), ('key below a regular expression', 1)))}) AS t(k, n) ON d.doc_id % {corpus.COUNT} = t.k GROUP BY 1")
def remediate_totals(spark, sf):
    f = jobs._sources(files(spark, sf))
    found = run_rules(f, [secrets.credential_hits, secrets.named_secrets_frontend]).where(F.col("fix").isNotNull())
    return jobs.remediate_files(f, found)[1].select("repo_id", "attempted", "applied", "skipped")


@query("append_rls", f"SELECT d.source AS repo_id, replace(t.path, '{{id}}', d.doc_id::VARCHAR) AS path, 'ALTER TABLE ' || replace(t.tab, '{{id}}', d.doc_id::VARCHAR) || ' ENABLE ROW LEVEL SECURITY;' AS added FROM documents d JOIN (VALUES ({_A}, 'supabase/migrations/{{id}}_a.sql', 'public.widgets_{{id}}'), ({_B}, 'supabase/migrations/{{id}}_t.sql', 'public.gadgets_{{id}}')) AS t(k, path, tab) ON d.doc_id % {corpus.COUNT} = t.k")
def append_rls(spark, sf):
    f = sqlrls.migrations(files(spark, sf))
    out = remediate.append_rls(f, sqlrls.missing_rls_per_file(f))
    return out.select("repo_id", "path", F.element_at(F.split(F.rtrim(F.regexp_replace("content", r"\n\z", "")), "\n"), -1).alias("added"))


@query("pin_manifest", f"SELECT d.source AS repo_id, 'packages/p_' || d.doc_id || '/package.json' AS path, '{{\"alpha\":\"latest\",\"beta\":\"1.2.3\",\"gamma\":\"1.x\",\"next\":\"^14.0.0\",\"react\":\"^18.2.0\"}}' AS dependencies FROM documents d WHERE d.doc_id % {corpus.COUNT} = {corpus.index_of('unpinned manifest')}")
def pin_manifest(spark, sf):
    rows, _ = deps.parse_manifests(files(spark, sf).where(pf.is_manifest(F.col("path")) & F.col("path").contains("/p_")))
    return remediate.pin_manifest(rows)


@query("inject_import", f"SELECT repo_id, path, CAST(1 + doc_id % 5 AS INTEGER) AS line FROM (SELECT source AS repo_id, 'src/named_' || doc_id || '.ts' AS path, doc_id FROM documents WHERE doc_id % {corpus.COUNT} = {corpus.index_of('named secret')})")
def inject_import(spark, sf):
    """Line of the import after the leading comments, in files with a named secret."""
    f = files(spark, sf).where(F.col("path").startswith("src/named_"))
    once = f.withColumn("content", remediate.inject_import(F.col("content")))
    twice = once.withColumn("content", remediate.inject_import(F.col("content")))
    return lexical.lines(twice).where(F.col("text").startswith("import 'dotenv/config'")).select("repo_id", "path", "line")
