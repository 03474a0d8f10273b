import os
import re

from pyspark.sql import functions as F

from riskspark import corpus
from riskspark.operators import dataflow, modules, post, remediate
from riskspark.plans import jobs
from riskspark.sources import readers

KEY = "sk_live_abcdefgh12345678"


def _write(root, mapping):
    for path, text in mapping.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def test_readers(spark, tmp_path):
    _write(tmp_path, {
        "one/src/a b.ts": "x", "one/src/a.d.ts": "x", "one/node_modules/m.js": "x", "one/t.spec.js": "x", "two/.env": "K=1", "two/conf/c.yaml": "a: 1",
        "two/supabase/migrations/1.sql": "select 1", "two/package.json": '{"dependencies":{"a":"latest"}}', "two/bad/package.json": "{",
    })
    root = str(tmp_path)
    assert {(r.repo_id, r.path) for r in readers.read_source_tree(spark, root).collect()} == {("one", "src/a b.ts")}
    mixed = {r.path for r in readers.read_mixed_tree(spark, root).collect()}
    assert "conf/c.yaml" in mixed and "node_modules/m.js" not in mixed
    assert [r.path for r in readers.read_migrations(spark, root).collect()] == ["supabase/migrations/1.sql"]
    deps, bad = readers.read_manifests(spark, root)
    assert [(r.name, r.version) for r in deps.collect()] == [("a", "latest")]
    assert [r.path for r in bad.collect()] == ["bad/package.json"]


def test_rule_file(spark, tmp_path):
    _write(tmp_path, {"p.json": '{"ignorePaths":["x/"," "],"ignoreRules":["ssrf"],"custom_rules":[{"name":"n","severity":"warn","target_files":["src"],"forbidden_pattern":{"type":"required_wrapper","wrapper":"w"}},{"name":"b","severity":"warn","target_files":[],"forbidden_pattern":{"type":"required_wrapper","wrapper":"w"}}]}'})
    rules, errors, paths, ids = readers.read_rules(spark, str(tmp_path))
    assert [r.name for r in rules.collect()] == ["n"]
    assert [r.reason for r in errors.collect()] == ["target_files is required"]
    assert [r.pattern for r in paths.collect()] == ["x/"] and [r.rule_id for r in ids.collect()] == ["ssrf"]


def test_fixes_reject_overlap_and_stale(spark, files):
    f = files({"a": "0123456789", "b": "0123456789", "c": "éx23"})
    fixes = spark.createDataFrame(
        [("r", "a", "k", 1, 3, "12", "A"), ("r", "a", "k", 2, 5, "234", "B"), ("r", "b", "k", 1, 3, "zz", "A"), ("r", "c", "k", 2, 3, "x", "long"), ("r", "c", "k", 2, 3, "x", "long"), ("r", "c", "k", 0, 2, "é", "")],
        "repo_id string, path string, kind string, start_byte int, end_byte int, expected_text string, replacement string",
    )
    got = {r.path: (r.status, r.content, r.applied) for r in remediate.apply_fixes(f, fixes).collect()}
    assert got == {"a": ("overlap", "0123456789", 0), "b": ("stale", "0123456789", 0), "c": ("patched", "long23", 2)}


def test_unified_diff_errors(spark, files):
    f = files({"a": "1\n2\n3", "b": "1"})
    p = spark.createDataFrame([("r", "a", "@@ -2,1 +2,2 @@\n-2\n+x\n+y\n"), ("r", "b", "no hunk")], "repo_id string, path string, diff string")
    got = {r.path: (r.content, r.error) for r in remediate.apply_unified_diff(f, p).collect()}
    assert got == {"a": ("1\nx\ny\n3", None), "b": ("1", "no applicable hunk")}


def test_module_taint_cycle(files):
    f = files({"a.ts": "export * from './b';\nexport const SECRET_A = 1;", "b.ts": "export * from './a';", "c.tsx": "'use client'\nimport { SECRET_A as s } from './b';"})
    rows = modules.module_taint(f).collect()
    assert [(r.path, r.line, r.variable, r.source_file) for r in rows] == [("c.tsx", 2, "s", "b.ts")]


def test_trail_suppression(files):
    src = "const a = req.query.a;\n// scan-ignore: command-injection\nexec(a);\n"
    assert dataflow.exploit_paths(files({"a.ts": src.replace("// scan-ignore: command-injection", "//")})).count() == 1
    assert dataflow.exploit_paths(files({"a.ts": src})).count() == 0


def test_scan_suppression_is_for_the_next_line_only(files):
    f = files({"a.ts": f'// scan-ignore: frontend-secret\nconst a = "{KEY}";\nconst b = "{KEY}";\n'})
    kept, gone = jobs.scan_project(f)
    assert [r.line for r in kept.collect()] == [3]
    assert [(r.line, r.directive_line) for r in gone.collect()] == [(2, 1)]


def test_hot_repo_report_is_split_whole(spark, files):
    from riskspark.sources import sinks

    f = files({f"src/f{i}.ts": f'const a = "{KEY}";' for i in range(40)})
    kept, _ = jobs.scan_project(f)
    docs = sinks.sarif_documents(kept, per_document=10)
    n = F.size(F.from_json(F.get_json_object("document", "$.runs[0].results"), "array<struct<ruleId:string>>"))
    assert docs.count() == 4 and docs.agg(F.sum(n)).first()[0] == 40
    rows = docs.orderBy("part").collect()
    assert [(r.part, r.first, r.results) for r in rows] == [(0, 1, 10), (1, 11, 10), (2, 21, 10), (3, 31, 10)]
    uris = [u for r in rows for u in re.findall(r'"uri":"([^"]+)"', r.document)]
    assert uris == sorted(uris)


def test_rank_runs_over_the_whole_repository(spark):
    rows = [(r, f"p{i % 7}", i % 3 or None, "x" if i % 2 else "y", str(i % 5), i) for i in range(200) for r in (["big"] if i % 10 else ["big", "small"])]
    df = spark.createDataFrame(rows, "repo_id string, path string, line int, rule_id string, evidence string, seq long")
    got = {(r.repo_id, r.seq): r.rank for r in post.sort_findings(df).collect()}
    for repo in ("big", "small"):
        mine = sorted((x for x in rows if x[0] == repo), key=lambda x: (x[1], x[2] or -1, x[3], x[4], x[5]))
        assert [got[repo, x[5]] for x in mine] == list(range(1, len(mine) + 1))


def test_context_budget_truncates_the_last(files):
    f = files({"a": "x" * 10, "b": "y" * 10, "c": "z" * 10})
    got = {r.path: r.content for r in post.context_budget(f, ["repo_id"], ["path"], 15).collect()}
    assert got["a"] == "x" * 10 and got["b"].startswith("yyyyy\n") and "c" not in got


def test_parts_of_the_corpus_are_no_larger_than_splits(spark, tmp_path):
    """a larger table is dealt to more tasks, not to larger ones."""
    spark.range(64).selectExpr("id doc_id", "'s' source", "repeat('word ', 2000) text").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "1k")
        splits = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
        assert splits >= 16
        assert corpus.source_files(spark, str(tmp_path)).rdd.getNumPartitions() >= splits
    finally:
        spark.conf.set(name, old)
