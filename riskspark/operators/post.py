"""Findings after the rules: policy, suppression, dedupe, ordering, verdicts, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import paths as pf, scalars as sc, text as tx
from riskspark.functions.text import find_all
from riskspark.operators.ordered import prefix_by_range

SCAN_RANK = {"critical": 0, "high": 1, "warning": 2}


# --- policy -----------------------------------------------------------------------------------

def of_repositories(repos: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy rows that hold for each repository in ``repos``: its own and those of '*'."""
    wanted = repos.select("repo_id").distinct().select("repo_id", F.explode(F.array_distinct(F.array("repo_id", F.lit("*")))).alias("_policy"))
    return wanted.join(policy.withColumnRenamed("repo_id", "_policy"), "_policy").drop("_policy")


def path_ignored(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows whose path is a test file or matches an ignore pattern of its repository, flagged ``ignored``.

    A repository's patterns are one array, so each row meets one policy row and
    a large repository makes no row for every path and pattern.
    """
    own = of_repositories(rows, patterns.select("repo_id", "pattern")).groupBy("repo_id").agg(F.collect_set("pattern").alias("_patterns"))
    hit = F.exists("_patterns", lambda p: pf.matches_ignore(F.col("path"), p))
    flagged = rows.join(own, "repo_id", "left")
    return flagged.withColumn("ignored", F.coalesce(hit, F.lit(False)) | pf.is_test_path(F.col("path"))).drop("_patterns")


def apply_policy(findings: DataFrame, ignore_rules: DataFrame, ignore_paths: DataFrame) -> DataFrame:
    """Drop findings of ignored rules and on ignored paths."""
    ignored = of_repositories(findings, ignore_rules.select("repo_id", "rule_id")).distinct()
    kept = findings.join(ignored, ["repo_id", "rule_id"], "left_anti")
    return path_ignored(kept, ignore_paths).where(~F.col("ignored")).drop("ignored")


def scope_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Only changed files inside the target (relative paths that do not climb out)."""
    inside = changed.where((F.col("path") != "") & ~F.col("path").startswith("..") & ~F.col("path").startswith("/"))
    return files.join(inside.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")


def changed_files(diff_names: DataFrame, untracked: DataFrame, files: DataFrame, ignore_paths: DataFrame) -> DataFrame:
    """Changed or untracked paths: distinct, scannable, not ignored, existing."""
    names = diff_names.select("repo_id", F.trim("path").alias("path")).unionByName(untracked.select("repo_id", F.trim("path").alias("path")))
    wanted = names.where(F.col("path") != "").distinct().where(pf.is_scannable(F.col("path")))
    kept = path_ignored(wanted, ignore_paths).where(~F.col("ignored")).drop("ignored")
    return kept.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


# --- suppression --------------------------------------------------------------------------------

def directives(files: DataFrame, tag: str = "scan-ignore") -> DataFrame:
    """Suppression comments of source files: (repo_id, path, line, rule_id); ``line`` is the line they apply to.

    The comment must stand alone on its line and name one rule.
    """
    p = rf"(?m)(?<=\n|^)[^\S\n]*//[^\S\n]*(?i:{tag}):[^\S\n]*[A-Za-z0-9_-]+[^\S\n]*(?=\n|\z)"
    hits = files.where(F.col("ext").isin(fv.SOURCE_EXTENSIONS) & pf.is_source(F.col("path")) & F.col("content").rlike(f"(?i){tag}:")).select(
        "repo_id", "path", F.explode(find_all(F.col("content"), p)).alias("h")
    )
    rule = F.lower(F.regexp_extract("h.text", r":\s*([A-Za-z0-9_-]+)\s*\z", 1))
    return hits.select("repo_id", "path", (F.col("h.line") + 1).alias("line"), rule.alias("rule_id")).distinct()


def suppress(findings: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): a finding is suppressed by a comment on the line before it."""
    key = findings.withColumn("_rule", F.lower("rule_id"))
    marks = comments.select("repo_id", "path", "line", F.col("rule_id").alias("_rule"))
    on = ["repo_id", "path", "line", "_rule"]
    kept = key.join(marks, on, "left_anti").drop("_rule")
    gone = key.join(marks, on, "left_semi").select("repo_id", "rule_id", "path", "line", (F.col("line") - 1).alias("directive_line"))
    return kept, gone


def suppression_note(suppressed: DataFrame) -> DataFrame:
    """Per repository: total, the first five entries, and how many more there are."""
    w = Window.partitionBy("repo_id").orderBy("path", "line", "rule_id")
    entry = F.concat(F.lit("ignored "), "rule_id", F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string"))
    top = suppressed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fv.SUPPRESSION_NOTE_ROWS)
    shown = top.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", entry.alias("e")))), lambda x: x["e"]), "\n").alias("entries")
    )
    totals = suppressed.groupBy("repo_id").agg(F.count("*").alias("total"))
    return totals.join(shown, "repo_id").withColumn("more", F.greatest(F.col("total") - fv.SUPPRESSION_NOTE_ROWS, F.lit(0)))


# --- dedupe, order --------------------------------------------------------------------------------

def dedupe_findings(findings: DataFrame) -> DataFrame:
    """First row (by ``seq``) per rule, path, line and evidence.

    min_by pre-aggregates on the map side, so many copies of one finding do not
    travel.
    """
    cols = findings.columns
    key = [F.col("repo_id"), F.col("rule_id"), F.col("path"), F.col("line"), F.coalesce("evidence", F.lit("")).alias("_evidence")]
    first = findings.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col("seq")).alias("_f"))
    return first.select("_f.*")


def drop_redundant_ambiguous(findings: DataFrame) -> DataFrame:
    """Ambiguous rows go where a precise rule hit the same line, or where a file has a
    path-traversal row and the evidence is about path.join."""
    ambiguous = F.col("rule_id") == "ambiguous-ast"
    precise = findings.where(F.col("rule_id").isin(fv.PRECISE_RULES))
    at = precise.select("repo_id", "path", "line").distinct()
    in_file = precise.where(F.col("rule_id") == "path-traversal").select("repo_id", "path").distinct()
    left = findings.where(ambiguous).join(at, ["repo_id", "path", "line"], "left_anti")
    about = F.coalesce(F.col("evidence"), F.lit("")).rlike(r"(?<!\w)path\s*\.\s*join(?!\w)")
    left = left.where(~about).unionByName(left.where(about).join(in_file, ["repo_id", "path"], "left_anti"))
    return findings.where(~ambiguous).unionByName(left.select(findings.columns))


ORDER = ["path", "line", "rule_id", "_evidence", "seq"]


def sort_findings(findings: DataFrame) -> DataFrame:
    """Add ``rank``: the row's place in its repository by path, line, rule, evidence and seq, from 1; null lines come first.

    Rows are dealt by range of (repository, order), so a repository with most of the rows is ranked in many tasks.
    """
    rows = findings.withColumn("_evidence", F.coalesce("evidence", F.lit("")))
    ranked = prefix_by_range(rows, ["repo_id"], ORDER, F.lit(1), "rank")
    return ranked.withColumn("rank", F.col("rank") + 1).select(*findings.columns, "rank")


def _gate_rank() -> Column:
    return F.when(F.col("severity") == "HARD_BLOCK", 0).when(F.col("severity") == "WARNING", 1)


def ordered_findings(gate: DataFrame) -> DataFrame:
    """HARD_BLOCK rows, then WARNING rows, each in ``seq`` order."""
    return gate.withColumn("rank", _gate_rank()).where(F.col("rank").isNotNull()).orderBy("rank", "seq")


def first_hard_block(gate: DataFrame, exploits: DataFrame) -> DataFrame:
    """Per repository: the first exploit row, else the first gate row, that blocks."""
    pick = lambda df, prio: df.where(F.col("severity") == "HARD_BLOCK").select("repo_id", "path", "issue", "seq", F.lit(prio).alias("prio"))
    both = pick(exploits, 0).unionByName(pick(gate, 1))
    return both.groupBy("repo_id").agg(F.min_by(F.struct("path", "issue", "prio"), F.struct("prio", "seq")).alias("f")).select("repo_id", "f.*")


def is_hard_block(severity: Column) -> Column:
    return severity.isin("critical", "HARD_BLOCK")


def findings_for_file(findings: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """Findings of one file; absolute and root-relative paths are the same file."""
    want = F.lit(path) if root is None else sc.absolute_path(F.lit(root), F.lit(path))
    have = F.col("path") if root is None else sc.absolute_path(F.lit(root), F.col("path"))
    return findings.where(have == want)


# --- unions -----------------------------------------------------------------------------------------

def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings in one table; ``seq`` is renumbered so earlier parts come first."""
    out = None
    for i, part in enumerate(parts):
        seq = F.col("seq") if "seq" in part.columns else F.lit(0)
        part = part.withColumn("seq", (F.lit(i).cast("bigint") * 1_000_000_000_000) + seq.cast("bigint"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def gate_union(fast: DataFrame, migration: DataFrame) -> DataFrame:
    """Gate rows of both scanners with their source tag."""
    return fast.withColumn("source", F.lit("fast-check")).unionByName(
        migration.withColumn("source", F.lit("supabase-migration")), allowMissingColumns=True
    )


def alert_clears(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Files that were blocked and are not any more."""
    return previous.select("repo_id", "path").distinct().join(current.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")


# --- verdicts and patches -------------------------------------------------------------------------------

def validate_verdicts(verdicts: DataFrame) -> DataFrame:
    """Add ``error``: NULL for a verdict whose fields agree with its state."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    s = F.col("state")
    error = (
        F.when(~F.coalesce(s.isin("RED", "YELLOW", "GREEN"), F.lit(False)), "state must be RED, YELLOW, or GREEN")
        .when(blank("reasoning"), "reasoning must be a non-empty string")
        .when((s == "YELLOW") & blank("manual_qa_line"), "manual_qa_line must be a non-empty string for YELLOW")
        .when((s != "YELLOW") & F.col("manual_qa_line").isNotNull(), "manual_qa_line must be null for RED or GREEN")
        .when((s == "RED") & blank("auto_patch"), "auto_patch must be a non-empty unified diff for RED")
        .when((s != "RED") & F.col("auto_patch").isNotNull(), "auto_patch must be null for YELLOW or GREEN")
    )
    return verdicts.withColumn("error", error)


def validate_patches(patches: DataFrame) -> DataFrame:
    """Add ``clean_path`` and ``error``; paths must stay inside the workspace."""
    p = F.replace(F.trim("file_path"), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    error = (
        F.when(~F.coalesce(F.col("action").isin("update", "create", "delete"), F.lit(False)), "action must be update, create, or delete")
        .when(F.col("new_content").isNull(), "new_content must be a string")
        .when(F.coalesce(p, F.lit("")) == "", "file_path must be a non-empty string")
        .when(p.startswith("/") | p.rlike("^[A-Za-z]:/") | (F.size(parts) == 0) | F.array_contains(parts, ".."), "file_path must stay inside the workspace")
    )
    return patches.withColumn("error", error).withColumn("clean_path", F.when(F.col("error").isNull(), F.array_join(parts, "/")))


def merge_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace a repository's ambiguous findings by its verdict.

    SAFE/GREEN drops them, VULNERABLE/RED makes one critical row, any other state
    a warning row, a patch set a PATCH row; without a verdict (no row, or one
    with neither state nor patch set) they stay.
    ``verdicts`` has one row per repo_id: state, reasoning, manual_qa_line,
    auto_patch, patch_count, explanation.
    """
    ambiguous = (F.col("rule_id") == "ambiguous-ast") | F.coalesce(F.upper("state") == "AMBIGUOUS", F.lit(False))
    unsure = findings.where(ambiguous)
    rest = findings.where(~ambiguous)
    verdicts = verdicts.where(F.col("state").isNotNull() | F.col("patch_count").isNotNull())
    keep = unsure.join(verdicts.select("repo_id"), "repo_id", "left_anti")
    first = unsure.groupBy("repo_id").agg(F.min(F.struct("path", "line", "seq")).alias("at"))
    v = verdicts.withColumn(
        "_state", F.when(F.upper("state") == "GREEN", "SAFE").when(F.upper("state") == "RED", "VULNERABLE")
        .when(F.upper("state") == "YELLOW", "AMBIGUOUS").otherwise(F.upper("state"))
    ).withColumnRenamed("state", "_raw")
    j = first.join(v, "repo_id")
    patched = F.col("patch_count").isNotNull()
    plural = F.when(F.col("patch_count") == 1, "").otherwise("es")
    rows = j.where(patched | F.col("_state").isNotNull()).where(patched | (F.col("_state") != "SAFE")).select(
        "repo_id", F.col("at.path").alias("path"), F.col("at.seq").alias("seq"), F.lit("llm-reasoning").alias("rule_id"),
        F.when(patched | (F.col("_state") == "VULNERABLE"), "critical").otherwise("warning").alias("severity"),
        F.when(patched, "PATCH").otherwise(F.col("_state")).alias("state"), F.col("at.line").alias("line"),
        F.when(patched, F.coalesce("explanation", F.lit(fv.PATCH_MESSAGE))).otherwise(F.coalesce("reasoning", F.lit(fv.VERDICT_MESSAGE))).alias("message"),
        F.when(patched, F.concat(F.lit("Reasoning Engine proposed "), F.col("patch_count").cast("string"), F.lit(" patch"), plural, F.lit(".")))
        .when(F.col("auto_patch").isNotNull(), F.lit("Reasoning Engine returned an auto-patch."))
        .otherwise(F.coalesce("manual_qa_line", F.concat(F.lit("Reasoning Engine verdict: "), F.col("_state")))).alias("evidence"),
        F.lit(True).alias("requires_deep"),
    )
    return dedupe_findings(rest.unionByName(keep).unionByName(rows, allowMissingColumns=True))


def patch_conflicts(patches: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applicable, conflicting) patch sets; one touched file already modified blocks the whole set."""
    touched = applied.select("repo_id", F.col("path").alias("file_path")).distinct()
    bad = patches.join(touched, ["repo_id", "file_path"], "left_semi").select("repo_id", "patch_set").distinct()
    return patches.join(bad, ["repo_id", "patch_set"], "left_anti"), patches.join(bad, ["repo_id", "patch_set"], "left_semi")


def fix_lane(rule_id: Column, fix_kind: Column, has_patch_set: Column) -> Column:
    """offline: can be fixed locally; deep: needs a patch set; unsupported: neither."""
    return (
        F.when(has_patch_set & (rule_id == "llm-reasoning"), "deep")
        .when(fix_kind.isin("credential", "scaffold-server-action", "sql-remediation"), "offline")
        .otherwise("unsupported")
    )


def ambiguity_diff(findings: DataFrame) -> DataFrame:
    """Per ambiguous row: a diff header and two annotated lines."""
    text = F.concat(
        F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n+// AST_STATE=AMBIGUOUS line="),
        F.coalesce("line", F.lit(1)).cast("string"), F.lit(" reason="), F.coalesce("ambiguity_reason", F.lit("unknown")),
        F.lit("\n+// "), F.coalesce("evidence", F.lit("Local AST proof surrendered.")),
    )
    rows = findings.where((F.col("rule_id") == "ambiguous-ast") | (F.col("state") == "AMBIGUOUS"))
    return rows.select("repo_id", "path", "line", text.alias("diff"))


def context_budget(files: DataFrame, keys: list[str], order: list[str], max_bytes: int = fv.CONTEXT_BYTES) -> DataFrame:
    """Keep files, in order, until the byte budget is spent; the last one is truncated.

    Sizes are summed without the text; content is attached to kept files only.
    """
    sized = files.where(F.trim("path") != "").select(*keys, *[c for c in order if c not in keys], F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes"))
    placed = prefix_by_range(sized, keys, order, F.col("bytes"), "before").where(F.col("before") < max_bytes)
    on = list(dict.fromkeys(keys + order))
    return files.join(placed.select(*on, "before"), on).withColumn(
        "content", sc.truncate_utf8(F.col("content"), (F.lit(max_bytes) - F.col("before")).cast("int"))
    ).drop("before")


# --- fixes ----------------------------------------------------------------------------------------------

def dedupe_fixes(fixes: DataFrame) -> DataFrame:
    """Exact duplicates by kind, range, texts and engine."""
    keys = ["kind", "start_byte", "end_byte", "expected_text", "replacement", "engine"]
    return fixes.dropDuplicates(["repo_id", "path", *[k for k in keys if k in fixes.columns]])


def overlapping_fixes(fixes: DataFrame, keys: list[str] | None = None, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Adjacent pairs, ordered by start, where the next range begins before the previous ends."""
    keys = keys or ["repo_id", "path"]
    w = Window.partitionBy(*keys).orderBy(start, end)
    return fixes.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def line_map(content: Column) -> Column:
    return F.size(F.split(content, tx.LINE_BREAK, -1))
