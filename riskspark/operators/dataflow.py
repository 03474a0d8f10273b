"""Data-flow graph per file: nodes, edges, source-to-sink paths, payload probing.

Statement-level stand-in for a syntax-tree graph: values, definitions, calls and
returns.  Known losses: references inside deeply nested expressions collapse to
their statement, and a suppression comment covers the statement line below it,
not every node of a longer statement.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark import fixed_values as fv, schemas
from riskspark.functions import lexer, paths as pf, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import IDENT, find_all, words
from riskspark.operators.findings import Source, prepare, source
from riskspark.session import checkpoint

NODE_KEYS = ["repo_id", "path", "node_id"]
COMPACT = 8


def sink_kind(node_type: Column, text: Column) -> Column:
    """Sink kind of a node; the last kind that matches wins."""
    call = node_type == "call_expression"
    built = node_type.isin("binary_expression", "template_string") & text.rlike(java(fv.CPG_SQL_TEXT))
    out = F.when(built, "raw-sql-construction")
    for kind, pattern in reversed(fv.CPG_SINKS):
        out = out.when(call & text.rlike(java(pattern)), kind)
    return out


def is_source_node(node_type: Column, text: Column) -> Column:
    eligible = node_type.isin("member_expression", "subscript_expression", "call_expression", "identifier", "property_identifier")
    return eligible & text.rlike(java(fv.CPG_SOURCE))


def _value_type(a: Column) -> Column:
    v, shape = a["value"], a["shape"]
    return (
        F.when(v.rlike(rf"\A{IDENT}\z"), "identifier")
        .when(v.rlike(r"\A(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>|\A(?:async\s+)?function\b"), "arrow_function")
        .when(v.rlike(r"\Aawait\b"), "await_expression")
        .when(shape == "call", "call_expression")
        .when(shape == "member", "member_expression")
        .when(v.rlike(r"\A`[^`]*`\z"), "template_string")
        .when(v.rlike(r"\A['\"]"), F.when(v.contains("+"), "binary_expression").otherwise("string"))
        .when(v.contains("+"), "binary_expression")
        .otherwise("expression")
    )


def _facts(f: Source) -> Column:
    """struct<assigns, calls, returns> of one file; node ids are start*4 + kind."""
    assigns = F.transform(
        F.filter(f.spans["assigns"], lambda a: ~a["declared"] | (F.size(a["names"]) == 1)),
        lambda a: F.struct(
            a["start"].alias("start"), a["line"].alias("line"), a["names"].alias("names"), a["value"].alias("value"),
            _value_type(a).alias("vtype"), a["declared"].alias("declared"),
        ),
    )
    returns = find_all(f.bare, rf"(?<![\w$.])return\b(?:[^;\n]|{tx.MORE})*")
    return F.struct(
        assigns.alias("assigns"), f.spans["calls"].alias("calls"),
        F.transform(returns, lambda r: F.struct(r["start"].alias("start"), r["line"].alias("line"), r["text"].alias("text"))).alias("returns"),
    )


def statements(files: DataFrame, tag: str | None = "scan-ignore") -> DataFrame:
    """Assignments, calls and returns of files that read request input, from one pass over the text."""
    if "s" in files.columns:
        return files
    base = prepare(files.where(pf.is_source(F.col("path")) & F.col("content").rlike("(?i)req|searchparams|formdata|headers") & F.col("content").rlike(java(fv.CPG_SOURCE))), lexer.CALLS)
    found = ignore_rows(F.col("content"), tag) if tag else F.lit(None)
    return base.select("repo_id", "path", _facts(source()).alias("s"), found.alias("ignores"))


def cpg_nodes(files: DataFrame, tag: str = "scan-ignore") -> DataFrame:
    """(repo_id, path, node_id, line, node_type, text, symbol, is_source, sink_kind, ignore_rules)."""
    row = lambda node, line, typ, text, sym: F.struct(
        node.cast("bigint").alias("node_id"), line.alias("line"), F.lit(typ).alias("node_type") if isinstance(typ, str) else typ.alias("node_type"),
        text.alias("text"), sym.cast("string").alias("symbol"),
    )
    s = F.col("s")
    nodes = F.concat(
        F.transform(s["assigns"], lambda a: row(a["start"] * 4, a["line"], a["vtype"], a["value"], F.lit(None))),
        F.flatten(F.transform(s["assigns"], lambda a: F.transform(a["names"], lambda n, i: row(a["start"] * 4 + 1, a["line"], "identifier", n, n)))),
        F.transform(s["calls"], lambda c: row(c["start"] * 4 + 2, c["line"], "call_expression", c["text"], F.lit(None))),
        F.transform(s["returns"], lambda r: row(r["start"] * 4 + 3, r["line"], "return_statement", r["text"], F.lit(None))),
    )
    stmts = statements(files, tag)
    flat = stmts.select("repo_id", "path", F.explode(nodes).alias("n")).select("repo_id", "path", "n.*")
    flat = flat.withColumn("is_source", is_source_node(F.col("node_type"), F.col("text"))).withColumn(
        "sink_kind", sink_kind(F.col("node_type"), F.col("text"))
    )
    return flat.join(ignore_directives(stmts), ["repo_id", "path", "line"], "left").withColumn(
        "ignore_rules", F.coalesce("ignore_rules", F.expr("cast(array() as array<string>)"))
    )


def ignore_rows(content: Column, tag: str) -> Column:
    """array<struct<at, rule>>: rules named in comments, with the comment's last line.

    Rule names are folded: lower case, '-' and spaces to '_'.
    """
    p = rf"(?i){tag}:\s*([A-Z0-9_,\-\s]+)"
    fold = lambda r: F.regexp_replace(F.lower(F.trim(r)), r"[\s-]+", "_")
    rows = F.transform(
        find_all(content, r"//[^\n]*|/\*[\s\S]*?\*/", lambda t: t.rlike(p)),
        lambda c: F.transform(
            F.filter(F.transform(F.split(F.regexp_extract(c["text"], p, 1), r"[,\s]+"), fold), lambda r: r != ""),
            lambda r: F.struct((c["line"] + tx.newlines(c["text"])).alias("at"), r.alias("rule")),
        ),
    )
    return F.when(content.rlike(f"(?i){tag}:"), F.flatten(rows))


def ignore_directives(stmts: DataFrame) -> DataFrame:
    """(repo_id, path, line, ignore_rules): a comment covers its own line and the one below."""
    spread = stmts.select("repo_id", "path", F.explode("ignores").alias("i")).select(
        "repo_id", "path", F.explode(F.array(F.col("i.at"), F.col("i.at") + 1)).alias("line"), F.col("i.rule").alias("rule")
    )
    return spread.groupBy("repo_id", "path", "line").agg(F.array_sort(F.collect_set("rule")).alias("ignore_rules"))


def cpg_edges(files: DataFrame) -> DataFrame:
    """Data-flow edges (repo_id, path, src, dst, label, seq).

    A use links to the last definition of its symbol at or before it: one
    window over (file, symbol), no pair-wise join.
    """
    s = F.col("s")
    defs = F.flatten(
        F.transform(
            s["assigns"],
            lambda a: F.transform(a["names"], lambda n: F.struct(n.alias("symbol"), a["start"].alias("pos"), F.lit(0).alias("rank"),
                                                                 (a["start"] * 4 + 1).cast("bigint").alias("node"), F.lit(None).cast("string").alias("label"))),
        )
    )

    def uses(rows, node, text, label):
        return F.flatten(
            F.transform(
                rows,
                lambda r: F.transform(
                    F.array_distinct(words(text(r))),
                    lambda w: F.struct(w.alias("symbol"), r["start"].alias("pos"), F.lit(1).alias("rank"), node(r).cast("bigint").alias("node"), label(r).alias("label")),
                ),
            )
        )

    strip = lambda c: F.regexp_replace(c, tx.STRING, " ")
    name = lambda a: F.element_at(a["names"], -1)
    all_rows = F.concat(
        defs,
        uses(s["assigns"], lambda a: a["start"] * 4 + 1, lambda a: strip(a["value"]),
             lambda a: F.concat(F.when(a["declared"], "flows-to:").otherwise("assigned-to:"), name(a))),
        uses(s["calls"], lambda c: c["start"] * 4 + 2, lambda c: strip(c["args"]), lambda c: F.lit("argument")),
        uses(s["returns"], lambda r: r["start"] * 4 + 3, lambda r: r["text"], lambda r: F.lit("return")),
    )
    stmts = statements(files)
    flat = stmts.select("repo_id", "path", F.explode(all_rows).alias("u")).select("repo_id", "path", "u.*")
    w = Window.partitionBy("repo_id", "path", "symbol").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = flat.withColumn("src", F.last(F.when(F.col("rank") == 0, F.col("node")), ignorenulls=True).over(w))
    by_use = linked.where((F.col("rank") == 1) & F.col("src").isNotNull()).select(
        "repo_id", "path", "src", F.col("node").alias("dst"), "label", F.col("pos").alias("seq")
    )
    defines = stmts.select("repo_id", "path", F.explode(F.transform(s["assigns"], lambda a: F.struct(
        (a["start"] * 4).cast("bigint").alias("src"), (a["start"] * 4 + 1).cast("bigint").alias("dst"), F.lit("defines").alias("label"), a["start"].alias("seq"))
    )).alias("e")).select("repo_id", "path", "e.*")
    # a definition inside a callback argument also feeds the call that holds the callback
    holders = F.filter(s["calls"], lambda c: c["args"].rlike(r"=>|\bfunction\b"))
    nested = stmts.select("repo_id", "path", F.explode(F.flatten(F.transform(
        s["assigns"],
        lambda a: F.transform(
            F.filter(holders, lambda c: (c["start"] < a["start"]) & (a["start"] < c["start"] + F.length(c["text"]))),
            lambda c: F.struct((a["start"] * 4 + 1).cast("bigint").alias("src"), (c["start"] * 4 + 2).cast("bigint").alias("dst"),
                               F.lit("argument").alias("label"), c["start"].alias("seq")),
        ),
    ))).alias("e")).select("repo_id", "path", "e.*")
    return by_use.unionByName(defines).unionByName(nested).dropDuplicates(["repo_id", "path", "src", "dst", "label"])


# --- tracing --------------------------------------------------------------------------------------

def trace_to_sink(edges: DataFrame, sources: DataFrame, sinks: DataFrame, keys: list[str]) -> DataFrame:
    """First sink each source reaches, breadth first, with the node trail.

    ``edges`` (keys…, src, dst, seq), ``sources`` and ``sinks`` (keys…, node).  A row of the state is one (source, node)
    with the node it was reached from and its place in the queue; nothing in it grows with the depth.  The place of a new
    node follows from its parent's place and the edge's number, so ties are settled as a queue would.  A source leaves
    the frontier once it reached a sink, and no node is visited twice, so the loop ends by itself.  Trails are read
    backwards at the end, one row per source and level.
    """
    ident = keys + ["source"]
    edges = edges.select(*keys, F.col("src").alias("node"), "dst", "seq")
    start = sources.select(*keys, F.col("node").alias("source")).distinct()
    frontier = checkpoint(start.select(*ident, F.col("source").alias("node"), F.lit(1).alias("place")))
    seen = frontier.select(*ident, "node")
    sink_nodes = sinks.select(*keys, "node").distinct().withColumn("hit", F.lit(True))
    queue = Window.partitionBy(*ident).orderBy("b.place", "b.seq", "node")
    levels = []
    for depth in itertools.count(1):
        step = frontier.join(edges, keys + ["node"]).select(
            *ident, F.col("dst").alias("node"), F.struct("place", "seq", F.col("node").alias("parent")).alias("b"))
        best = step.groupBy(*ident, "node").agg(F.min("b").alias("b")).join(seen, ident + ["node"], "left_anti")
        fresh = best.select(*ident, "node", "b.parent", F.row_number().over(queue).alias("place")).join(sink_nodes, keys + ["node"], "left")
        fresh = checkpoint(fresh.select(*ident, "node", "parent", "place", "hit"))
        if fresh.isEmpty():
            break
        hits = fresh.where("hit").groupBy(*ident).agg(F.min_by("node", "place").alias("node"))
        levels.append((fresh.select(*ident, "node", "parent"), hits))
        seen = seen.unionByName(fresh.select(*ident, "node"))
        if depth % COMPACT == 0:
            seen = checkpoint(seen)
        frontier = fresh.where(F.col("hit").isNull()).select(*ident, "node", "place").join(hits.select(*ident), ident, "left_anti")
    return _trails(levels, start, ident)


def _trails(levels: list, start: DataFrame, ident: list[str]) -> DataFrame:
    """(keys…, source, sink, depth, trail) from the (node, parent) rows and hits of each depth, deepest first."""
    steps = start.limit(0).select(*ident, F.lit(0).alias("depth"), F.col("source").alias("node"))
    current = None
    for depth in range(len(levels), 0, -1):
        rows, hits = levels[depth - 1]
        wanted = hits if current is None else current.unionByName(hits)  # one trail per source
        here = rows.join(wanted, ident + ["node"], "left_semi")
        if depth % COMPACT == 0:
            here = checkpoint(here)
        steps = steps.unionByName(here.select(*ident, F.lit(depth).alias("depth"), "node"))
        current = here.select(*ident, F.col("parent").alias("node"))
    at = F.array_sort(F.collect_list(F.struct("depth", "node")))  # as long as one trail
    whole = steps.groupBy(*ident).agg(at.alias("t"))
    return whole.select(
        *ident, F.element_at("t", -1)["node"].alias("sink"), F.size("t").alias("depth"),
        F.concat(F.array("source"), F.transform("t", lambda x: x["node"])).alias("trail"))


def entry_keys(text: Column) -> Column:
    """Request keys a source reads: property, bracket and getter forms, distinct in that order."""
    parts = [
        r"\b(?:query|body|params|searchParams)\s*\.\s*([A-Za-z_$][\w$]*)",
        r"\b(?:query|body|params|searchParams)\s*\[\s*[\"']([^\"']+)[\"']\s*\]",
        r"\.get\s*\(\s*[\"']([^\"']+)[\"']\s*\)",
    ]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(java(p)), F.lit(1)) for p in parts]))


def entry_points(nodes: DataFrame) -> DataFrame:
    ignored = F.arrays_overlap("ignore_rules", F.array(F.lit("all"), F.lit("fuzzer")))
    return nodes.where(F.col("is_source") & ~ignored).select("repo_id", "path", "node_id", "line", entry_keys(F.col("text")).alias("keys"))


def payloads_for(vuln_type: Column) -> Column:
    """Catalogued payloads of a type, in order; one default probe for unknown types."""
    out = None
    for kind, values in fv.PAYLOADS.items():
        arr = F.array(*[F.lit(v) for v in values])
        out = F.when(vuln_type == kind, arr) if out is None else out.when(vuln_type == kind, arr)
    return out.otherwise(F.array(F.lit(fv.DEFAULT_PAYLOAD)))


def payload_survives(vuln_type: Column, texts: Column, sink_text: Column) -> Column:
    """No sanitizer in the trail, sink not parameterised, and the type's own test holds."""
    layout = F.array_join(texts, "\n")
    combined = F.concat_ws("\n", layout, sink_text)
    glue = r"\+|\$\{"
    sanitized = F.exists(texts, lambda t: t.rlike(java(fv.SANITIZER)))
    bound = combined.rlike(java(fv.PARAMETERIZED_SINK)) & ~combined.rlike(glue)
    argv = sink_text.rlike(java(r"\b(?:execFile|execFileSync)\s*\(\s*[\"'][^\"']+[\"']\s*,\s*\[")) & ~sink_text.rlike(java(r"(?i)\bshell\s*:\s*true\b"))
    typed = (
        F.when(vuln_type == "SQL_INJECTION", layout.rlike(glue) | sink_text.rlike("(?i)query|execute|rpc"))
        .when(vuln_type == "PATH_TRAVERSAL", layout.rlike("(?i)readFile|writeFile|createReadStream|path|file"))
        .when(vuln_type == "COMMAND_INJECTION", ~argv & (layout.rlike(glue) | sink_text.rlike("(?i)exec|spawn|shell")))
        .when(vuln_type == "AUTH_BYPASS", layout.rlike("(?i)auth|role|session|permission|admin"))
        .otherwise(F.lit(True))
    )
    return ~sanitized & ~bound & typed


def trail_ignored(rules: Column, vuln_type: Column) -> Column:
    """Any node of the trail names 'all', 'fuzzer' or the vulnerability type."""
    return F.exists(rules, lambda r: r.isin("all", "fuzzer") | (r == F.lower(vuln_type)))


def exploit_paths(files: DataFrame, tag: str = "scan-ignore") -> DataFrame:
    """Source-to-sink paths on which a payload survives; the first payload only."""
    stmts = checkpoint(statements(files, tag))
    nodes = checkpoint(cpg_nodes(stmts, tag))
    keys = ["repo_id", "path"]
    ignored = F.arrays_overlap("ignore_rules", F.array(F.lit("all"), F.lit("fuzzer")))
    sources = nodes.where(F.col("is_source") & ~ignored).select(*keys, F.col("node_id").alias("node"))
    sinks = nodes.where(F.col("sink_kind").isNotNull()).select(*keys, F.col("node_id").alias("node"))
    traces = trace_to_sink(checkpoint(cpg_edges(stmts)), sources, sinks, keys)
    steps = traces.select(*keys, "source", "sink", "depth", F.posexplode("trail").alias("step", "node_id"))
    named = steps.join(nodes.select(*keys, "node_id", "line", "text", "sink_kind", "ignore_rules"), keys + ["node_id"])
    # a trail is bounded by the statements of one file
    trail = F.array_sort(F.collect_list(F.struct("step", "line", "text", "ignore_rules")))
    whole = named.groupBy(*keys, "source", "sink", "depth").agg(
        trail.alias("t"), F.max_by("text", "step").alias("sink_text"), F.max_by("sink_kind", "step").alias("sink_kind")
    )
    typed = whole.withColumn("vuln_type", sc.classify_sink(F.col("sink_kind"), F.col("sink_text")))
    texts = F.transform("t", lambda n: n["text"])
    rules = F.flatten(F.transform("t", lambda n: n["ignore_rules"]))
    live = typed.where(~trail_ignored(rules, F.col("vuln_type")) & payload_survives(F.col("vuln_type"), texts, F.col("sink_text")))
    shown = F.transform("t", lambda n: F.struct(F.col("path").alias("path"), n["line"].cast("int").alias("line"), n["text"].alias("text")))
    return live.select(
        *keys, F.col("source").alias("source_id"), F.col("sink").alias("sink_id"), "vuln_type",
        F.get(payloads_for(F.col("vuln_type")), F.lit(0)).alias("payload"), "depth", shown.cast(schemas.TRAIL).alias("trail"),
        F.concat("vuln_type", F.lit(" payload reaches "), "sink_kind", F.lit(" without sanitizer or parameterization.")).alias("reason"),
    )
