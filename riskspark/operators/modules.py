"""Module boundaries: imports, exports, resolution, secret taint across files.

Every key starts with ``repo_id``.  Text never takes part in a join: the edge
tables hold names and lines only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import lexer
from riskspark.functions.regex import any_of, java
from riskspark.functions.text import IDENT, find_all, words
from riskspark.operators.findings import finding
from riskspark.session import checkpoint

COMPACT = 8

_FROM = r"\s*['\"]([^'\"\n]+)['\"]"
IMPORT = rf"(?<![\w$.])import(?:\s+[^;'\"()]*?\s+from)?{_FROM}"
RE_EXPORT = rf"(?<![\w$.])export\s+(?:\*(?:\s+as\s+{IDENT})?|(?:type\s+)?\{{[^}}]*\}})\s*from{_FROM}"
EXPORT = (
    rf"(?<![\w$.])export\s+(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*{IDENT}|class\s+{IDENT}|(?:const|let|var)\s+{IDENT}"
    rf"|\{{[^}}]*\}})"
)


def _source(stmt: Column) -> Column:
    return F.regexp_extract(stmt, r"['\"]([^'\"\n]+)['\"]\z", 1)


def _specifiers(body: Column) -> Column:
    """``a as b, c`` to array<struct<name, alias>>."""
    parts = F.transform(F.split(body, ","), lambda p: F.split(F.regexp_replace(F.trim(p), r"^type\s+", ""), r"\s+as\s+"))
    rows = F.transform(
        parts, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("name"), F.trim(F.element_at(p, -1)).alias("alias"))
    )
    return F.filter(rows, lambda r: r["name"].rlike(rf"\A{IDENT}\z") & r["alias"].rlike(rf"\A{IDENT}\z"))


def import_rows(code: Column) -> Column:
    """array<struct<line, source, imported, local>>; a bare import has no names."""

    def one(h):
        s, src = h["text"], _source(h["text"])
        row = lambda imported, local: F.struct(
            h["line"].alias("line"), src.alias("source"), imported.cast("string").alias("imported"), local.cast("string").alias("local")
        )
        default = F.regexp_extract(s, rf"^import\s+(?!type\s)({IDENT})\s*(?:,|\s+from\b)", 1)
        star = F.regexp_extract(s, rf"\*\s+as\s+({IDENT})", 1)
        named = F.transform(_specifiers(F.regexp_extract(s, r"\{([^}]*)\}", 1)), lambda r: row(r["name"], r["alias"]))
        rows = F.concat(
            F.filter(F.array(row(F.lit("default"), default), row(F.lit("*"), star)), lambda r: r["local"] != ""), named
        )
        return F.when(F.size(rows) > 0, rows).otherwise(F.array(row(F.lit(None), F.lit(None))))

    return F.flatten(F.transform(find_all(code, IMPORT), one))


def export_rows(code: Column) -> Column:
    """array<struct<line, name>> of exported local names."""

    def one(h):
        s = h["text"]
        named = F.transform(_specifiers(F.regexp_extract(s, r"\{([^}]*)\}", 1)), lambda r: r["alias"])
        single = F.regexp_extract(s, rf"(?:function\s*\*?|class|const|let|var)\s+({IDENT})\z", 1)
        return F.transform(
            F.filter(F.concat(F.array(single), named), lambda n: n != ""), lambda n: F.struct(h["line"].alias("line"), n.alias("name"))
        )

    return F.flatten(F.transform(find_all(code, EXPORT), one))


def re_export_rows(code: Column) -> Column:
    """array<struct<line, source, imported, exported>> of ``export … from``."""

    def one(h):
        s = h["text"]
        row = lambda i, e: F.struct(h["line"].alias("line"), _source(s).alias("source"), i.alias("imported"), e.alias("exported"))
        named = F.transform(_specifiers(F.regexp_extract(s, r"\{([^}]*)\}", 1)), lambda r: row(r["name"], r["alias"]))
        return F.when(s.rlike(r"^export\s+\*"), F.array(row(F.lit("*"), F.lit("*")))).otherwise(named)

    return F.flatten(F.transform(find_all(code, RE_EXPORT), one))


def import_word_rows(code: Column) -> Column:
    """array<struct<name, line>>: words of import statements with the statement's line."""
    return F.flatten(
        F.transform(
            find_all(code, IMPORT),
            lambda h: F.transform(F.array_distinct(words(h["text"])), lambda w: F.struct(w.alias("name"), h["line"].alias("line"))),
        )
    )


def seed_names(code: Column) -> Column:
    """Declared names that look secret or hold a credential-shaped value."""
    decl = rf"(?<![\w$.])(?:const|let|var)\s+({IDENT})\s*(?::[^=;\n]*+)?(?:=(?![=>])\s*([^;\n]*))?"
    secret = any_of([p for _, _, p, _ in fv.CREDENTIALS])
    hits = F.filter(
        F.regexp_extract_all(code, F.lit(decl), F.lit(0)),
        lambda m: F.regexp_extract(m, decl, 1).rlike(java(fv.TAINT_NAME)) | F.regexp_extract(m, decl, 2).rlike(secret),
    )
    return F.array_distinct(F.transform(hits, lambda m: F.regexp_extract(m, decl, 1)))


def module_facts(files: DataFrame) -> DataFrame:
    """Everything the module analyses need, from one pass over the text: names and lines only."""
    code = F.col("code")
    has = F.col("content").contains
    some = lambda word, rows: F.when(has(word), rows)
    masked = files.where(F.col("content").isNotNull()).withColumn("code", lexer.facts(F.col("content"))["code"])
    return masked.select(
        "repo_id", "path", some("import", import_rows(code)).alias("imports"), some("import", import_word_rows(code)).alias("import_words"),
        some("export", re_export_rows(code)).alias("re_exports"), some("export", export_rows(code)).alias("exports"),
        seed_names(code).alias("seeds"),
        F.coalesce(some("use client", code.rlike(r"(?m)^\s*['\"]use client['\"]\s*;?\s*$")), F.lit(False)).alias("is_client"),
    )


def _facts(table: DataFrame) -> DataFrame:
    return table if "imports" in table.columns else module_facts(table)


def imports(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, source, imported, local); default/named/namespace/bare imports."""
    return _facts(files).select("repo_id", "path", F.explode("imports").alias("i")).select("repo_id", "path", "i.*")


def exports(files: DataFrame) -> DataFrame:
    """Exported local names."""
    return _facts(files).select("repo_id", "path", F.explode("exports").alias("e")).select("repo_id", "path", "e.line", "e.name")


def re_exports(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, source, imported, exported) of ``export … from``."""
    return _facts(files).select("repo_id", "path", F.explode("re_exports").alias("e")).select("repo_id", "path", "e.*")


def import_line_map(files: DataFrame) -> DataFrame:
    """First import line that mentions a word: (repo_id, path, name, line)."""
    rows = _facts(files).select("repo_id", "path", F.explode("import_words").alias("w"))
    return rows.groupBy("repo_id", "path", F.col("w.name").alias("name")).agg(F.min("w.line").alias("line"))


def taint_seeds(files: DataFrame) -> DataFrame:
    """(repo_id, path, name) of secret-looking declarations."""
    return _facts(files).select("repo_id", "path", F.explode("seeds").alias("name"))


def client_files(files: DataFrame) -> DataFrame:
    """Files with a top-level 'use client' directive statement."""
    return _facts(files).where("is_client").select("repo_id", "path")


def local_import_sources(files: DataFrame) -> DataFrame:
    """Relative import / require sources, distinct per file."""
    c = F.col("content")
    found = F.concat(
        F.regexp_extract_all(c, F.lit(java(r"\bimport\s+(?:[\s\S]*?\s+from\s+)?['\"](.+?)['\"]")), F.lit(1)),
        F.regexp_extract_all(c, F.lit(java(r"\brequire\s*\(\s*['\"](.+?)['\"]\s*\)")), F.lit(1)),
    )
    local = F.array_distinct(F.filter(found, lambda s: s.startswith(".")))
    guard = c.contains("import") | c.contains("require")
    return files.where(guard).select("repo_id", "path", F.explode(local).alias("source"))


# --- resolution ---------------------------------------------------------------------------

def join_path(importer: Column, source: Column) -> Column:
    """Directory of ``importer`` + relative ``source``, with . and .. folded; NULL outside the root."""
    parts = F.concat(F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1), F.split(source, "/"))
    start = F.expr("cast(array() as array<string>)")

    def step(acc, p):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(p.isin("", "."), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, start, step), "/")


_CANDIDATES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``source_path``: the first existing candidate file of a relative source.

    The hash join is on (repo_id, candidate path); candidates are a fixed list of
    eight per distinct (importer folder, source).
    """
    pairs = edges.where(F.col("source").startswith(".")).select("repo_id", "path", "source").distinct()
    base = join_path(F.col("path"), F.col("source"))
    named = F.transform(
        F.array(*[F.lit(c) for c in _CANDIDATES]),
        lambda c, i: F.struct(i.alias("rank"), F.concat(F.col("base"), c).alias("candidate")),
    )
    exact = F.array(F.struct(F.lit(0).alias("rank"), F.col("base").alias("candidate")))
    cand = (
        pairs.withColumn("base", base).where(F.col("base").isNotNull())
        .withColumn("c", F.explode(F.when(F.col("base").rlike(r"[^/]\.[^/.]*\z"), exact).otherwise(named)))
        .select("repo_id", "path", "source", "c.rank", "c.candidate")
    )
    known = files.select("repo_id", F.col("path").alias("candidate")).distinct()
    best = (
        cand.join(known, ["repo_id", "candidate"])
        .groupBy("repo_id", "path", "source").agg(F.min_by("candidate", "rank").alias("source_path"))
    )
    return edges.join(best, ["repo_id", "path", "source"])


def module_edges(files: DataFrame) -> DataFrame:
    """Resolved name flow between files: (repo_id, importer, imported, local, source_path, kind).

    Takes a file table or its :func:`module_facts`.
    Default and namespace imports look up their local name in the source file.
    """
    imp = imports(files).where(F.col("imported").isNotNull()).select(
        "repo_id", "path", "source", F.when(F.col("imported").isin("default", "*"), F.col("local")).otherwise(F.col("imported")).alias("imported"),
        "local", F.lit("import").alias("kind"),
    )
    rex = re_exports(files).select(
        "repo_id", "path", "source", "imported", F.col("exported").alias("local"),
        F.when(F.col("imported") == "*", "export-all").otherwise("re-export").alias("kind"),
    )
    both = resolve_imports(imp.unionByName(rex), files)
    return both.select("repo_id", F.col("path").alias("importer"), "imported", "local", "source_path", "kind")


def module_taint_fixpoint(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All tainted (repo_id, path, name): semi-naive rounds over the resolved edges.

    Each round joins only the names found in the round before.  Names are
    finite and never found twice, so the loop ends by itself when a round adds
    nothing.  What is known is written as one table again after every
    ``COMPACT`` rounds, so a round never reads a long union.
    """
    edges = edges.select("repo_id", "importer", "imported", "local", "source_path", "kind").distinct()
    known = checkpoint(seeds.select("repo_id", "path", "name").distinct())
    fresh = known
    for k in itertools.count(1):
        src = fresh.select("repo_id", F.col("path").alias("source_path"), F.col("name").alias("tainted"))
        fresh = checkpoint(_reach(edges, src).distinct().join(known, ["repo_id", "path", "name"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if k % COMPACT == 0:
            known = checkpoint(known)


def _reach(edges: DataFrame, src: DataFrame) -> DataFrame:
    """One step; named edges join on the name as well, so no hot file fans out."""
    named = edges.where(F.col("kind") != "export-all").join(
        src.withColumnRenamed("tainted", "imported"), ["repo_id", "source_path", "imported"]
    ).select("repo_id", F.col("importer").alias("path"), F.col("local").alias("name"))
    every = edges.where(F.col("kind") == "export-all").join(src, ["repo_id", "source_path"]).select(
        "repo_id", F.col("importer").alias("path"), F.col("tainted").alias("name")
    )
    return named.unionByName(every)


def taint_violations(edges: DataFrame, tainted: DataFrame, clients: DataFrame, lines: DataFrame) -> DataFrame:
    """A client file imports a tainted name; line of the first import naming it, else 1."""
    imp = edges.where(F.col("kind") == "import")
    hot = tainted.select("repo_id", F.col("path").alias("source_path"), F.col("name").alias("imported"))
    hits = imp.join(hot, ["repo_id", "source_path", "imported"]).withColumnRenamed("importer", "path").join(
        clients, ["repo_id", "path"], "left_semi"
    )
    located = hits.join(lines.withColumnRenamed("name", "local"), ["repo_id", "path", "local"], "left")
    row = finding(
        rule_id="taint-violation", severity="critical", line=F.coalesce(F.col("line"), F.lit(1)),
        message=F.concat(F.lit("Client component imports tainted value "), F.col("local"), F.lit(".")),
        evidence=F.concat(F.lit("from "), F.col("source_path")), variable=F.col("local"), source_file=F.col("source_path"),
    )
    return located.select("repo_id", "path", row.alias("f")).select("repo_id", "path", "f.*")


def module_taint(files: DataFrame) -> DataFrame:
    """Seeds, fixpoint and violations over a file table; the text is read once."""
    facts = checkpoint(module_facts(files))
    edges = checkpoint(module_edges(facts))
    tainted = module_taint_fixpoint(edges, taint_seeds(facts))
    return taint_violations(edges, tainted, client_files(facts), import_line_map(facts))


def ambiguous_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Files with an ambiguous finding plus the local files they import: distinct (repo_id, path)."""
    start = findings.where((F.col("rule_id") == "ambiguous-ast") | (F.col("state") == "AMBIGUOUS")).select("repo_id", "path").distinct()
    edges = local_import_sources(files.join(start, ["repo_id", "path"], "left_semi"))
    linked = resolve_imports(edges, files).select("repo_id", F.col("source_path").alias("path"))
    return start.unionByName(linked).distinct()


# --- calls and custom rules ---------------------------------------------------------------------

_CALLEE = rf"(?:(?<![\w$.]){IDENT}|(?<=[)\]])\s*\??\.\s*{IDENT})(?:\s*\??\.\s*{IDENT})*+\s*\("


def call_sites(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, callee) of calls, comments and strings blanked."""
    hits = find_all(lexer.facts(F.col("content"))["bare"], _CALLEE, lambda t: ~t.rlike(r"\A(?:if|for|while|switch|catch|function|return)\b"))
    return files.where(F.col("content").contains("(")).select("repo_id", "path", F.explode(hits).alias("h")).select(
        "repo_id", "path", "h.line", F.regexp_replace(F.regexp_extract("h.text", r"\A([\s\S]*?)\s*\(\z", 1), r"\s+", "").alias("callee")
    )


def callee_is_imported(calls: DataFrame, imps: DataFrame) -> DataFrame:
    """Calls whose target is an imported function or a member of an imported namespace."""
    names = imps.where(F.col("local").isNotNull()).select(
        "repo_id", "path", F.col("local").alias("root"), (F.col("imported") == "*").alias("namespace")
    ).distinct()
    parts = F.split("callee", r"\.")
    keyed = calls.withColumn("root", F.get(parts, F.lit(0))).withColumn("depth", F.size(parts))
    hit = keyed.join(names, ["repo_id", "path", "root"]).where(
        ((F.col("depth") == 1) & ~F.col("namespace")) | ((F.col("depth") == 2) & F.col("namespace"))
    )
    return hit.select("repo_id", "path", "line", "callee").distinct()
