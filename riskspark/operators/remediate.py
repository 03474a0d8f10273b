"""Batch remediation: table in, patched table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions import lexer, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import let
from riskspark import fixed_values as fv
from riskspark.operators.lexical import lines
from riskspark.operators.post import dedupe_fixes


def _bytes(data: Column, start, length) -> Column:
    return F.substring(data, start, length)


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Patched files: (repo_id, path, content, status, attempted, applied).

    Exact duplicates are folded.  Overlapping ranges reject the file; a range
    whose bytes are not the expected text refuses the file as stale.  Kept text
    between ranges and replacements are joined once, left to right, which gives
    what right-to-left replacement gives.
    """
    unique = dedupe_fixes(fixes.where(F.col("replacement").isNotNull()))
    per_file = unique.groupBy("repo_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "expected_text", "replacement"))).alias("fx")
    )
    data = F.encode("content", "UTF-8")
    joined = files.join(per_file, ["repo_id", "path"]).withColumn("_data", data)
    fx = F.col("fx")
    starts, ends = F.transform(fx, lambda x: x["start_byte"]), F.transform(fx, lambda x: x["end_byte"])
    clash = F.exists(
        F.zip_with(F.slice(starts, F.lit(2), F.size(fx)), F.slice(ends, F.lit(1), F.size(fx) - 1), lambda s, e: s < e), lambda c: F.coalesce(c, F.lit(False))
    )
    stale = F.exists(fx, lambda x: _bytes(F.col("_data"), x["start_byte"] + 1, x["end_byte"] - x["start_byte"]).cast("string") != x["expected_text"])
    begin = F.concat(F.array(F.lit(0)), ends)
    pieces = F.transform(
        fx, lambda x, i: F.concat(_bytes(F.col("_data"), F.get(begin, i) + 1, x["start_byte"] - F.get(begin, i)).cast("string"), x["replacement"])
    )
    tail = _bytes(F.col("_data"), F.element_at(begin, -1) + 1, F.octet_length("content")).cast("string")
    status = F.when(clash, "overlap").when(stale, "stale").otherwise("patched")
    ok = F.col("status") == "patched"
    return joined.withColumn("status", status).select(
        "repo_id", "path", F.when(ok, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("content")).alias("content"),
        "status", F.size(fx).alias("attempted"), F.when(ok, F.size(fx)).otherwise(0).alias("applied"),
    )


def credential_fix(findings: DataFrame) -> DataFrame:
    """Fix rows of credential findings: literal to environment reference."""
    return findings.where(F.col("fix.kind") == "credential").select("repo_id", "path", "fix.*")


def parameterize_sql(snippet: Column) -> Column:
    """``'…' + a + …`` to ``({ text: "… $1 …", values: [a] })``; NULL if nothing to bind."""
    slots = lexer.facts(snippet, lexer.OPERANDS)["operands"]

    def split_template(t):
        inner = F.regexp_replace(t, r"\A`|`\z", "")
        return F.transform(
            F.regexp_extract_all(inner, F.lit(r"\$\{[^{}]*\}|[^$]+|\$"), F.lit(0)),
            lambda p: F.struct(
                F.when(p.startswith("${"), "e").otherwise("t").alias("kind"),
                F.when(p.startswith("${"), F.trim(F.regexp_extract(p, r"\A\$\{([^{}]*)\}\z", 1))).otherwise(p).alias("v"),
            ),
        )

    def as_parts(s):
        text = F.struct(F.lit("t").alias("kind"), sc.unquote(s).alias("v"))
        expr = F.struct(F.lit("e").alias("kind"), F.trim(s).alias("v"))
        return F.when(s.startswith("`"), split_template(s)).when(s.rlike("^['\"]"), F.array(text)).otherwise(F.array(expr))

    def build(parts):
        start = F.struct(F.lit("").alias("sql"), F.expr("cast(array() as array<string>)").alias("vals"))
        folded = F.aggregate(
            parts, start,
            lambda a, p: F.when(p["kind"] == "t", F.struct(F.concat(a["sql"], p["v"]).alias("sql"), a["vals"].alias("vals"))).otherwise(
                F.struct(F.concat(a["sql"], F.lit("$"), (F.size(a["vals"]) + 1).cast("string")).alias("sql"), F.concat(a["vals"], F.array(p["v"])).alias("vals"))
            ),
        )
        return let(folded, render)

    def render(r):
        sql = F.regexp_replace(F.trim(r["sql"]), r";+\s*\z", "")
        usable = (sql != "") & sc.collapse_ws(sql).rlike(java(fv.SQL_FRAGMENT)) & (F.size(r["vals"]) > 0)
        quoted = F.regexp_extract(F.to_json(F.struct(sql.alias("x"))), r"\A\{\"x\":([\s\S]*)\}\z", 1)
        return F.when(usable, F.concat(F.lit("({ text: "), quoted, F.lit(", values: ["), F.array_join(r["vals"], ", "), F.lit("] })")))

    return let(F.flatten(F.transform(slots, as_parts)), build)


def append_rls(files: DataFrame, missing: DataFrame) -> DataFrame:
    """Append ENABLE ROW LEVEL SECURITY for each missing (repo_id, path, table_name), in name order."""
    tables = missing.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))
    joined = files.join(tables, ["repo_id", "path"])
    have = F.transform(
        F.regexp_extract_all("content", F.lit(java(r"(?i)\balter\s+table\s+(\S+?)\s+enable\s+row\s+level\s+security\b")), F.lit(1)), F.lower
    )
    need = F.filter("tables", lambda t: ~F.array_contains(have, F.lower(t)))
    added = F.array_join(F.transform(need, lambda t: F.concat(F.lit("\n\nALTER TABLE "), t, F.lit(" ENABLE ROW LEVEL SECURITY;"))), "")
    patched = F.concat(F.regexp_replace("content", java(r"\s+$"), ""), added, F.lit("\n"))
    return joined.select("repo_id", "path", F.when(F.size(need) > 0, patched).otherwise(F.col("content")).alias("content"), F.size(need).alias("added"))


def pin_config_secret(files: DataFrame) -> DataFrame:
    """config.ts: quoted sk- literals become the environment reference."""
    out = F.regexp_replace("content", r"([\"'])sk-(?:proj-)?[A-Za-z0-9_-]+([\"'])", "process.env.OPENAI_API_KEY")
    rows = files.where(F.col("path").rlike(r"(?:^|/)config\.ts\z")).withColumn("patched", out).where(F.col("patched") != F.col("content"))
    return rows.select("repo_id", "path", F.when(F.col("patched").endswith("\n"), F.col("patched")).otherwise(F.concat("patched", F.lit("\n"))).alias("content"))


PINS = {"next": "^14.0.0", "react": "^18.2.0"}


def pin_manifest(deps: DataFrame) -> DataFrame:
    """Dependency rows with the two fixed versions set (added where absent), per manifest."""
    main = deps.where(F.col("block") == "dependencies")
    pinned = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("version")) for k, v in PINS.items()])
    # the version to keep for a name is the pinned one where there is one
    fixed = deps.select("repo_id", "path").distinct().select("repo_id", "path", F.explode(pinned).alias("p")).select("repo_id", "path", "p.*")
    kept = main.where(~F.col("name").isin(list(PINS))).select("repo_id", "path", "name", "version")
    rows = kept.unionByName(fixed)
    return rows.groupBy("repo_id", "path").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "version"))))).alias("dependencies")
    )


def inject_import(content: Column, statement: str = "import 'dotenv/config';") -> Column:
    """Add the environment import once, after leading blank and // lines."""
    line = statement + " // <-- Natively injected at root node\n"
    has = content.rlike(r"(?m)^\s*import\s+['\"]dotenv/config['\"];?")
    head = F.regexp_extract(content, r"\A(?:[^\S\n]*(?://[^\n]*)?(?:\n|\z))*+", 0)
    return F.when(has, content).otherwise(F.concat(head, F.lit(line), F.substring(content, F.length(head) + 1, F.length(content))))


def apply_unified_diff(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply one unified diff per file: (repo_id, path, content, error).

    Diff lines become operations on old line numbers; the file's lines are
    joined to them per (repo_id, path, old line) and put together again.
    """
    hunk = r"^@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@"
    keys = ["repo_id", "path"]
    ops = patches.select(*keys, F.posexplode(F.split("diff", tx.LINE_BREAK, -1)).alias("seq", "raw"))
    by_file = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ops = ops.withColumn("old_start", F.regexp_extract("raw", hunk, 1).try_cast("int")).withColumn(
        "hunk", F.sum(F.when(F.col("raw").startswith("@@ "), 1).otherwise(0)).over(by_file)
    )
    bad = ops.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("raw").startswith("@@ ") & F.coalesce(F.col("old_start") == 0, F.lit(True))), "unsupported hunk")
        .when(F.max("hunk") == 0, "no applicable hunk").alias("error")
    )
    body = ops.where((F.col("hunk") > 0) & ~F.col("raw").startswith("\\ No newline"))
    kind = (
        F.when(F.col("raw").startswith("@@ "), "@").when(F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"), "+")
        .when(F.col("raw").startswith("-") & ~F.col("raw").startswith("---"), "-").when(F.col("raw").startswith(" "), " ")
    )
    body = body.withColumn("op", kind).where(F.col("op").isNotNull())
    by_hunk = Window.partitionBy(*keys, "hunk").orderBy("seq")
    first = F.first("old_start", ignorenulls=True).over(by_hunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    eaten = F.coalesce(F.sum(F.when(F.col("op").isin("-", " "), 1).otherwise(0)).over(by_hunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = body.withColumn("at", (first + eaten).cast("int")).where(F.col("op") != "@")
    src = lines(files.join(patches.select(*keys), keys, "left_semi")).withColumnRenamed("line", "at")
    touched = placed.where(F.col("op").isin("-", " "))
    kept = src.join(touched.where(F.col("op") == "-").select(*keys, "at"), keys + ["at"], "left_anti").select(*keys, "at", F.lit(1_000_000_000).alias("sub"), "text")
    beyond = touched.where(F.col("op") == " ").join(src.select(*keys, "at"), keys + ["at"], "left_anti").select(*keys, "at", "seq", F.expr("substring(raw, 2)").alias("text"))
    added = placed.where(F.col("op") == "+").select(*keys, "at", F.col("seq").alias("sub"), F.expr("substring(raw, 2)").alias("text"))
    rows = kept.unionByName(added).unionByName(beyond.withColumnRenamed("seq", "sub"))
    # one file's lines come back together: bounded by the file
    text = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", "text"))), lambda x: x["text"]), "\n").alias("patched"))
    out = files.join(bad, keys).join(text, keys, "left")
    return out.select(*keys, F.when(F.col("error").isNull(), F.coalesce("patched", F.lit(""))).otherwise(F.col("content")).alias("content"), "error")


def ci_preview(findings: DataFrame) -> DataFrame:
    """CI mode: previews instead of edits, secrets redacted; (repo_id, path, line, before, after)."""
    return findings.where(F.col("fix.kind") == "credential").select(
        "repo_id", "path", "line", sc.redact(F.col("fix.expected_text")).alias("before"), F.col("fix.replacement").alias("after")
    )
