"""Policy of all repositories, one-sided policy, verdicts without content, users made by their own batch, order of what is shown."""

import json
from collections import Counter

from pyspark.sql import functions as F

from riskspark.operators import custom, governance, modules, post
from riskspark.plans import jobs
from riskspark.sources import readers, sinks

FINDING = "repo_id string, rule_id string, severity string, state string, path string, line int, message string, evidence string, seq bigint"


def findings(spark, rows):
    return spark.createDataFrame([(r, rule, "critical", state, p, line, None, "e", seq) for r, rule, state, p, line, seq in rows], FINDING)


def test_policy_file_without_repository_holds_for_all(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps({
        "ignorePaths": ["legacy/**"], "ignoreRules": ["ssrf"],
        "custom_rules": [{"name": "no-moment", "severity": "warn", "target_files": ["src/**"], "forbidden_pattern": {"type": "forbidden_import", "import_path": "moment"}}]}))
    rules, errors, paths, ignored = readers.read_rules(spark, str(tmp_path))
    assert errors.count() == 0
    found = findings(spark, [("a", "ssrf", None, "src/a.ts", 1, 1), ("a", "sql-injection", None, "legacy/a.ts", 1, 2), ("b", "sql-injection", None, "src/b.ts", 1, 3)])
    assert [r.repo_id for r in post.apply_policy(found, ignored, paths).collect()] == ["b"]
    files = spark.createDataFrame([("a", "src/a.ts"), ("b", "src/b.ts"), ("b", "lib/b.ts")], "repo_id string, path string")
    assert sorted((r.repo_id, r.path, r.name) for r in custom.custom_rule_targets(files, rules).collect()) == [("a", "src/a.ts", "no-moment"), ("b", "src/b.ts", "no-moment")]
    permitted = spark.createDataFrame([("a", True, "pro"), ("b", False, "pro")], "repo_id string, allowed boolean, tier string")
    assert [r.repo_id for r in custom.gate_rules(rules, permitted).collect()] == ["a"]


def test_own_and_common_policy_add_up(spark):
    rows = spark.createDataFrame([("a", "x/1.ts"), ("a", "y/1.ts"), ("b", "x/1.ts"), ("b", "y/1.ts"), ("b", "z/1.ts")], "repo_id string, path string")
    patterns = spark.createDataFrame([("*", "x/**"), ("b", "y/**")], "repo_id string, pattern string")
    assert sorted((r.repo_id, r.path) for r in post.path_ignored(rows, patterns).where("ignored").collect()) == [("a", "x/1.ts"), ("b", "x/1.ts"), ("b", "y/1.ts")]


def test_one_sided_policy(spark):
    found = findings(spark, [("a", "ssrf", None, "src/a.ts", 1, 1), ("a", "sql-injection", None, "legacy/a.ts", 1, 2)])
    rule = spark.createDataFrame([("a", "ssrf")], "repo_id string, rule_id string")
    path = spark.createDataFrame([("*", "legacy/**")], "repo_id string, pattern string")
    assert [r.rule_id for r in jobs._with_policy(found, rule, None).collect()] == ["sql-injection"]
    assert [r.rule_id for r in jobs._with_policy(found, None, path).collect()] == ["ssrf"]


def test_verdict_without_content_keeps_findings(spark):
    found = findings(spark, [("a", "ambiguous-ast", "AMBIGUOUS", "z.ts", 9, 1), ("a", "ambiguous-ast", "AMBIGUOUS", "b.ts", 4, 2), ("b", "ambiguous-ast", "AMBIGUOUS", "b.ts", 1, 3)])
    schema = "repo_id string, state string, reasoning string, manual_qa_line string, auto_patch string, patch_count int, explanation string"
    verdicts = spark.createDataFrame([("b", None, "r", None, None, None, None), ("a", "ODD", None, None, None, None, None)], schema)
    got = sorted((r.repo_id, r.rule_id, r.path, r.line, r.severity, r.state) for r in post.merge_verdicts(found, verdicts).collect())
    assert got == [("a", "llm-reasoning", "b.ts", 4, "warning", "ODD"), ("b", "ambiguous-ast", "b.ts", 1, "critical", "AMBIGUOUS")]


def test_users_made_by_the_same_batch(spark):
    schema = "event_id string, ts int, error string, user_ref string, email string, trial_credits int, token_hash string, label string, seats int, license_status string, license_tier string"
    event = lambda i, ref, mail, error=None: (f"e{i}", i, error, ref, mail, i, f"t{i}", "l", 1, "ACTIVE", "PRO")
    events = spark.createDataFrame([
        event(1, "u5", "m5"), event(2, None, "m5"), event(3, "u5", None), event(4, "u9", None), event(5, None, None), event(6, "u6", "old"),
        event(7, None, "new"), event(8, None, "new"), event(9, "u7", "new"), event(10, "u1", None), event(11, None, "old")], schema)
    users = spark.createDataFrame([("u1", "old", 0)], "id string, email string, trial_credits int")
    licenses = spark.createDataFrame([], "token_hash string, label string, seats int, status string, tier string, user_id string")
    people, keys, rejects = governance.entitlement_upsert(events, users, licenses)
    people = {r.id: (r.email, r.trial_credits) for r in people.collect()}
    new = next(i for i, (mail, _) in people.items() if mail == "new")
    assert people == {"u1": ("old", 11), "u5": ("m5", 3), new: ("new", 8)}
    assert {r.token_hash: r.user_id for r in keys.collect()} == {"t1": "u5", "t2": "u5", "t3": "u5", "t7": new, "t8": new, "t10": "u1", "t11": "u1"}
    assert {r.event_id: r.reason for r in rejects.collect()} == {
        "e4": "unknown user without e-mail", "e5": "no user", "e6": "e-mail belongs to another user", "e9": "e-mail belongs to another user"}


def test_events_that_name_nobody_do_not_meet_in_one_task(spark):
    """they match no user, so their place in the order deals them out."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ["-1", "false"]):
            spark.conf.set(n, v)
        events = spark.range(4000).selectExpr(
            "concat('e', id) event_id", "id ts", "cast(null as string) error", "if(id < 0, 'x', null) user_ref", "if(id < 0, 'y', null) email", "1 trial_credits",
            "concat('t', id) token_hash", "'l' label", "1 seats", "'ACTIVE' license_status", "'PRO' license_tier")
        users = spark.createDataFrame([("u1", "old", 0)], "id string, email string, trial_credits int")
        licenses = spark.createDataFrame([], "token_hash string, label string, seats int, status string, tier string, user_id string")
        rejects = governance.entitlement_upsert(events, users, licenses)[2]
        per_task = [r["count"] for r in rejects.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert sum(per_task) == 4000 and max(per_task) < 1000


def test_summary_shows_the_first_rows_by_path_and_line(spark):
    found = findings(spark, [("a", "ssrf", None, f"f{i % 9}.ts", 100 - i, i) for i in range(90)])
    repos = spark.createDataFrame([("a",)], "repo_id string")
    shown = [x.split("`")[3] for x in sinks.ci_summary(found, repos).first().markdown.split("\n") if x.startswith("| critical")]
    want = sorted((f"f{i % 9}.ts", 100 - i) for i in range(90))[:50]
    assert shown == [f"{p}:{line}" for p, line in want]


def test_long_chains_end_by_themselves(spark):
    n = 2 * modules.COMPACT + 3
    edges = spark.createDataFrame([("r", f"m{i + 1}", "k", "k", f"m{i}", "import") for i in range(n)], "repo_id string, importer string, imported string, local string, source_path string, kind string")
    seeds = spark.createDataFrame([("r", "m0", "k")], "repo_id string, path string, name string")
    assert modules.module_taint_fixpoint(edges, seeds).where(F.col("name") == "k").count() == n + 1


def test_rows_of_a_busy_owner_do_not_meet_in_one_task(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 4 > 0, "Acme").alias("repo_owner")).repartition(4)
    orgs = spark.createDataFrame([("7", "acme", ["acme-hub"], None), ("9", "other", None, ["Acme"])], "id string, slug string, github_orgs array<string>, gitlab_groups array<string>")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = governance.org_for_repo(rows, orgs)
        assert found.columns == ["repo_owner", "id", "organization_id"]
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.organization_id) for r in got) == [(i, "7" if i % 4 else None) for i in range(2000)]
    per_task = Counter(r.task for r in got)
    assert max(per_task.values()) < 1000
