"""SQL migrations: statements, created tables, row-level-security checks.

Two scanners differ on purpose and stay separate: the full scan compares
schema-qualified names over a whole repository and does not strip comments; the
gate strips comments, keeps names as written and looks at one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import paths as pf, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import find_all, let
from riskspark.operators.findings import Source, finding, when

_DOLLAR = r"(\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$)[\s\S]*?(?:\1|\z)"
_SQL_SKIP = r"--[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|'[^']*+(?:'|\z)|\"[^\"]*+(?:\"|\z)"


def strip_sql_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"--[^\n\r]*", ""), r"/\*[\s\S]*?\*/", "")


def mask_sql(sql: Column) -> Column:
    """Comments, quotes and dollar-quoted bodies blanked, length and lines kept."""
    lex = rf"{_DOLLAR}|{_SQL_SKIP}"
    merged = F.zip_with(
        F.split(sql, lex, -1), F.regexp_extract_all(sql, F.lit(lex), F.lit(0)),
        lambda p, t: F.concat(p, F.coalesce(F.regexp_replace(t, r"[^\n]", " "), F.lit(""))),
    )
    return F.array_join(merged, "")


def statements_of(sql: Column) -> Column:
    """array<struct<sql, offset, line>>: statements split on top-level ``;``.

    ``line`` is where the statement's first non-blank character stands.
    """
    ends = lambda m: F.concat(F.transform(find_all(m, ";"), lambda h: h["start"] + 1), F.array(F.length(m)))

    def cut(s):
        starts = F.concat(F.array(F.lit(0)), s["e"])
        rows = F.zip_with(F.slice(starts, F.lit(1), F.size(s["e"])), s["e"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        pieces = F.transform(
            rows, lambda r: F.struct(F.substring(sql, r["a"] + 1, r["b"] - r["a"]).alias("sql"), r["a"].alias("offset"))
        )
        # the last piece is what follows the final ';' and counts only if it is not blank
        kept = F.filter(pieces, lambda p: F.trim(F.regexp_replace(p["sql"], java(r"\s+"), " ")) != "")
        lead = lambda p: F.length(F.regexp_extract(p["sql"], java(r"^\s*"), 0))
        return F.transform(
            kept,
            lambda p: F.struct(p["sql"].alias("sql"), p["offset"].alias("offset"), tx.line_at(sql, p["offset"] + lead(p)).alias("line")),
        )

    return let(mask_sql(sql), lambda m: let(F.struct(ends(m).alias("e")), cut))


def sql_statements(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", F.posexplode(statements_of(F.col("content"))).alias("stmt", "s")).select(
        "repo_id", "path", "stmt", "s.sql", "s.offset", "s.line"
    )


def created_tables(files: DataFrame) -> DataFrame:
    """Full scan: (repo_id, path, table, line) of CREATE TABLE statements.

    The line is that of the statement's first character, which may be a comment.
    """
    create = java(fv.CREATE_TABLE)
    body = F.regexp_replace(strip_sql_comments(F.col("sql")), java(r"^\s+"), "")
    name = F.regexp_extract(body, r"\A" + create.replace("(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))create", "create", 1), 1)
    return (
        sql_statements(files.where(F.col("content").rlike(r"(?i)create")))
        .select("repo_id", "path", "line", name.alias("raw"))
        .where(F.col("raw") != "")
        .select("repo_id", "path", sc.norm_sql_identifier(F.col("raw")).alias("table_name"), "line")
    )


def enabled_tables(files: DataFrame) -> DataFrame:
    """Full scan: tables with ENABLE ROW LEVEL SECURITY (comments count)."""
    p = java(fv.ENABLE_RLS)
    hit = F.col("hit")
    part = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(hit, p, a), F.lit("")), F.nullif(F.regexp_extract(hit, p, b), F.lit("")))
    return files.where(F.col("content").rlike(p)).select(
        "repo_id", "path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("hit")
    ).select("repo_id", "path", F.concat_ws(".", F.lower(F.coalesce(part(1, 2), F.lit("public"))), F.lower(part(3, 4))).alias("table_name"))


def _missing(created: DataFrame, enabled: DataFrame, keys: list[str]) -> DataFrame:
    gone = created.join(enabled.select(*keys).distinct(), keys, "left_anti")
    row = finding(
        rule_id="missing-rls", severity="high", line=F.col("line"), table_name=F.col("table_name"),
        message=F.concat(F.lit("Table "), F.col("table_name"), F.lit(" is created without enabling Row Level Security.")),
    )
    return gone.select("repo_id", "path", row.alias("f")).select("repo_id", "path", "f.*")


def missing_rls(files: DataFrame) -> DataFrame:
    """Created tables with no ENABLE RLS anywhere in the repository's migrations."""
    return _missing(created_tables(files), enabled_tables(files), ["repo_id", "table_name"])


def missing_rls_per_file(files: DataFrame) -> DataFrame:
    """Diff scan: the ENABLE RLS must stand in the same file."""
    return _missing(created_tables(files), enabled_tables(files), ["repo_id", "path", "table_name"])


def rls_tautology(f: Source) -> Column:
    """USING / WITH CHECK comparing two literals that is always true."""
    p = java(fv.POLICY_PREDICATE)
    hits = F.transform(
        find_all(f.content, p),
        lambda h: F.struct(h["line"].alias("line"), let(F.regexp_extract(h["text"], p, 1), sc.static_predicate).alias("why")),
    )
    found = F.transform(
        F.filter(hits, lambda h: h["why"].isNotNull()),
        lambda h: finding(rule_id="missing-rls", severity="critical", line=h["line"], message=fv.MSG_TAUTOLOGY, evidence=h["why"]),
    )
    return when(f.content.rlike(r"(?i)using|check"), found)


# --- gate ----------------------------------------------------------------------------------

def gate_created(sql: Column) -> Column:
    return F.transform(F.regexp_extract_all(sql, F.lit(java(fv.CREATE_TABLE)), F.lit(1)), sc.gate_table_name)


def gate_enabled(sql: Column) -> Column:
    return F.transform(F.regexp_extract_all(sql, F.lit(java(fv.GATE_ENABLE_RLS)), F.lit(1)), lambda n: F.lower(sc.gate_table_name(n)))


def _covers(enabled: Column, table: Column) -> Column:
    """Enabled under the full name, or under any schema with the same last part."""
    last = F.lower(F.element_at(F.split(table, r"\."), -1))
    return F.exists(enabled, lambda e: (e == F.lower(table)) | (F.element_at(F.split(e, r"\."), -1) == last))


def migration_report(files: DataFrame) -> DataFrame:
    """One row per migration: status, errors, warnings, tables."""

    def row(sql):
        def build(s):
            bad = F.filter(s["t"], lambda t: ~_covers(s["e"], t))
            errors = F.transform(bad, lambda t: F.concat(F.lit("Table '"), t, F.lit("' is missing ENABLE ROW LEVEL SECURITY.")))
            warnings = F.array_compact(
                F.array(
                    F.when(s["sql"].rlike(java(fv.USING_TRUE)), fv.USING_TRUE_LABEL),
                    F.when(s["sql"].rlike(java(fv.CHECK_TRUE)), fv.CHECK_TRUE_LABEL),
                )
            )
            status = F.when(F.size(errors) > 0, "HARD_BLOCK").when(F.size(warnings) > 0, "WARNING").otherwise("PASSED")
            return F.struct(status.alias("status"), errors.alias("errors"), warnings.alias("warnings"), s["t"].alias("tables"))

        return let(
            sql, lambda q: let(F.struct(gate_created(q).alias("t"), gate_enabled(q).alias("e"), q.alias("sql")), build)
        )

    return files.select("repo_id", "path", row(strip_sql_comments(F.col("content"))).alias("r")).select("repo_id", "path", "r.*")


def migration_rollup(report: DataFrame) -> DataFrame:
    """Per repository: counts and overall status (HARD_BLOCK > WARNING > PASSED)."""
    rank = F.when(F.col("status") == "HARD_BLOCK", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    top = F.max(rank)
    return report.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum(F.size("tables")).alias("tables"), F.sum(F.size("errors")).alias("errors"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.when(top == 2, "HARD_BLOCK").when(top == 1, "WARNING").otherwise("PASSED").alias("status"),
    )


def gate_missing_rls(report: DataFrame) -> DataFrame:
    """Gate rows: errors as HARD_BLOCK, warnings as WARNING."""
    def tagged(col, sev):
        return F.transform(F.col(col), lambda i: F.struct(i.alias("issue"), F.lit(sev).alias("severity")))

    return report.select(
        "repo_id", "path", F.explode(F.concat(tagged("errors", "HARD_BLOCK"), tagged("warnings", "WARNING"))).alias("g")
    ).select("repo_id", "path", "g.issue", "g.severity")


def migrations(files: DataFrame) -> DataFrame:
    return files.where((F.col("ext") == "sql") & pf.is_migration(F.col("path")))
