"""Request taint and the injection rules that use it.

Taint is a fixpoint over the assignments of one file, held in one row
(:func:`riskspark.functions.text.fixpoint`), so it needs no shuffle.

Calls, assignments, functions and ``+`` chains come from the lexer, which knows
every bracket's partner, so nesting has no limit.  Known loss against a syntax
tree: an initializer ends at a line break outside brackets unless an operator
stands on either side of the break.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import lexer, paths as pf, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import IDENT, find_all, fixpoint, let, words
from riskspark.operators.findings import Source, finding, none, when


# --- request-controlled variables (text level) ---------------------------------------

def _names(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def _edges(text: Column, pattern: str, kind: str) -> Column:
    p = java(pattern)
    return F.transform(
        F.regexp_extract_all(text, F.lit(p), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, p, 1).alias("name"), words(F.regexp_extract(m, p, 2)).alias("reads"), F.lit(kind).alias("kind")
        ),
    )


def request_edges(content: Column) -> Column:
    """array<struct<name, reads, kind>>: which variable is built from which names."""
    return F.concat(
        _edges(content, fv.PROPERTY_EDGE, "property"),
        _edges(content, fv.ALIAS_EDGE, "alias"),
        _edges(content, fv.CALL_EDGE, "call"),
        _edges(content, fv.PATH_JOIN_EDGE, "path-join"),
    )


def request_vars(content: Column) -> Column:
    """Variables that hold request input, directly or through assignments."""
    seeds = F.concat(*[_names(content, p) for p in fv.REQUEST_DIRECT])
    objects = _names(content, fv.REQUEST_JSON)

    def solve(s: Column) -> Column:
        def uses(edge, names):
            by_object = (edge["kind"] == "property") & F.arrays_overlap(edge["reads"], s["objects"])
            return by_object | F.arrays_overlap(edge["reads"], names)

        # a JSON body seeds its property reads; it is not itself a tainted name
        from_objects = F.transform(
            F.filter(s["edges"], lambda e: (e["kind"] == "property") & F.arrays_overlap(e["reads"], s["objects"])),
            lambda e: e["name"],
        )
        return fixpoint(F.concat(s["seeds"], from_objects), s["edges"], uses)

    state = F.struct(seeds.alias("seeds"), objects.alias("objects"), request_edges(content).alias("edges"))
    return F.when(content.contains("req") | content.contains("searchParams"), let(state, solve)).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def _mentions(text: Column, names: Column) -> Column:
    return F.arrays_overlap(words(text), names)


def command_injection(f: Source) -> Column:
    """Request-derived text reaches exec/execSync."""
    build_p, exec_p, static_p = java(fv.COMMAND_BUILD), java(fv.EXEC_CALL), java(fv.STATIC_COMMAND)

    def rows(tainted: Column) -> Column:
        static = F.transform(
            F.filter(
                F.regexp_extract_all(f.content, F.lit(static_p), F.lit(0)),
                lambda m: F.regexp_extract(m, r"=\s*([\s\S]*)\z", 1).rlike(java(fv.COMMAND_WORDS)),
            ),
            lambda m: F.regexp_extract(m, static_p, 1),
        )
        built = let(
            static,
            lambda st: F.transform(
                F.filter(
                    F.regexp_extract_all(f.content, F.lit(build_p), F.lit(0)),
                    lambda m: let(
                        F.regexp_extract(m, build_p, 2),
                        lambda e: (e.rlike(java(fv.REQUEST_MEMBER)) | _mentions(e, tainted))
                        & (e.rlike(java(fv.COMMAND_WORDS)) | _mentions(e, st)),
                    ),
                ),
                lambda m: F.regexp_extract(m, build_p, 1),
            ),
        )

        def hits(commands: Column) -> Column:
            found = F.filter(
                find_all(f.content, exec_p),
                lambda h: let(
                    F.regexp_extract(h["text"], exec_p, 2),
                    lambda a: F.array_contains(commands, a) | a.rlike(java(fv.REQUEST_MEMBER)) | _mentions(a, tainted),
                ),
            )
            return F.transform(
                found,
                lambda h: finding(
                    rule_id="command-injection", severity="critical", line=h["line"], message=fv.MSG_COMMAND,
                    evidence=sc.collapse_ws(h["text"]), requires_deep=True,
                ),
            )

        return let(built, hits)

    guard = pf.is_source(f.path) & f.content.contains("exec") & f.content.rlike(java(r"\b(?:exec|execSync)\s*\("))
    return when(guard, let(request_vars(f.content), rows))


def path_traversal(f: Source, scope: str = "file") -> Column:
    """Request-derived path reaches a file read with no boundary check.

    ``scope='file'``: one check anywhere silences the file.  ``scope='block'``:
    only a check in the enclosing block counts.
    """
    read_p = java(fv.FILE_READ)

    def rows(tainted: Column) -> Column:
        def unsafe(h):
            hit = _mentions(F.regexp_extract(h["text"], read_p, 2), tainted)
            if scope == "block":
                return hit & ~tx.block_text(f.content, f.spans["blocks"], h["start"]).rlike(java(fv.PATH_BOUNDARY))
            return hit

        return F.transform(
            F.filter(find_all(f.content, read_p), unsafe),
            lambda h: finding(
                rule_id="path-traversal", severity="critical", line=h["line"], message=fv.MSG_PATH,
                evidence=sc.collapse_ws(h["text"]), requires_deep=True,
            ),
        )

    guard = pf.is_source(f.path) & (f.content.contains("readFile") | f.content.contains("createReadStream"))
    if scope == "file":
        guard = guard & ~f.content.rlike(java(fv.PATH_BOUNDARY))
    return when(guard, let(request_vars(f.content), rows), lexer.BLOCKS if scope == "block" else 0)


def auth_bypass(f: Source) -> Column:
    """Account mutation whose block names a caller-supplied id and has no guard."""
    hits = F.concat(find_all(f.content, java(fv.ACCOUNT_MUTATION)), find_all(f.content, java(fv.SQL_ACCOUNT_MUTATION)))

    def open_door(h):
        return let(
            tx.block_text(f.content, f.spans["blocks"], h["start"]),
            lambda b: b.rlike(java(fv.USER_ID_NAMES)) & ~b.rlike(java(fv.AUTH_GUARD)),
        )

    found = F.transform(
        F.filter(hits, open_door),
        lambda h: finding(
            rule_id="auth-bypass", severity="critical", line=h["line"], message=fv.MSG_AUTH,
            evidence=sc.collapse_ws(h["text"]), requires_deep=True,
        ),
    )
    guard = f.content.rlike(r"(?i)updateBillingPlan|updateProfile|updateAccount|deleteAccount|transferOwnership|UPDATE\s")
    return when(pf.is_source(f.path) & guard, found, lexer.BLOCKS)


# --- SQL text built with + -----------------------------------------------------------

def sql_injection(f: Source) -> Column:
    """``+`` chain that reads as SQL and has a dynamic side; every such prefix is a finding."""
    sql = java(fv.SQL_FRAGMENT)

    def reads_as_sql(t):
        return sc.collapse_ws(t).rlike(sql)

    def dynamic(t):
        plain_template = t.startswith("`") & ~t.contains("${")
        return ~(t.rlike("^['\"]") | plain_template)

    def prefixes(h):
        def at(n):
            part, text = F.get(h["parts"], n), h["text"]
            left = F.left(text, F.get(h["parts"], n - 1)["end"])
            right = F.substring(text, part["at"] + 1, part["end"] - part["at"])
            left_dynamic = (n > 1) | dynamic(left)
            ok = (reads_as_sql(left) & dynamic(right)) | (reads_as_sql(right) & left_dynamic)
            whole = F.left(text, part["end"])
            return F.struct((ok & reads_as_sql(whole)).alias("ok"), whole.alias("text"))

        ends = F.transform(F.sequence(F.lit(1), F.size(h["parts"]) - 1), at)
        # outermost expression first, as the tree is walked
        rows = F.reverse(F.filter(ends, lambda e: F.coalesce(e["ok"], F.lit(False))))
        return F.transform(rows, lambda e: F.struct(h["start"].alias("start"), h["line"].alias("line"), e["text"].alias("text")))

    chains = F.filter(f.spans["chains"], lambda h: h["text"].rlike(sql))
    found = F.transform(
        F.flatten(F.transform(chains, prefixes)),
        lambda r: let(
            tx.byte_offset(f.content, r["start"]),
            lambda b: finding(
                rule_id="sql-injection", severity="critical", line=r["line"], message=fv.MSG_SQL, evidence=r["text"],
                fix=F.struct(
                    F.lit("sql-remediation").alias("kind"), F.lit(None).cast("string").alias("credential_id"),
                    F.lit(None).cast("string").alias("replacement"), r["text"].alias("expected_text"),
                    b.cast("int").alias("start_byte"), (b + F.octet_length(r["text"])).cast("int").alias("end_byte"),
                    r["text"].alias("raw_snippet"),
                ),
            ),
        ),
    )
    return when(pf.is_source(f.path) & f.content.contains("+") & f.content.rlike(r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE)\b"), found, lexer.CHAINS)


# --- server-side request forgery -----------------------------------------------------------

def trusted_validators(code: Column) -> Column:
    """struct<functions, namespaces> of validator-shaped imports from security-shaped modules."""
    stmts = F.filter(
        F.regexp_extract_all(code, F.lit(r"(?<![\w$.])import\s+[^;'\"]*?\s+from\s*['\"][^'\"]+['\"]"), F.lit(0)),
        lambda s: F.regexp_extract(s, r"['\"]([^'\"]+)['\"]", 1).rlike(java(fv.VALIDATOR_MODULE)),
    )
    name = java(fv.VALIDATOR_NAME)

    def functions(s):
        default = F.regexp_extract(s, rf"^import\s+({IDENT})\s*(?:,|\s+from)", 1)
        named = F.transform(F.split(F.regexp_extract(s, r"\{([^}]*)\}", 1), ","), F.trim)
        ok = F.filter(named, lambda p: p.rlike(name))
        return F.concat(
            F.filter(F.array(default), lambda d: d.rlike(name)),
            F.transform(ok, lambda p: F.trim(F.element_at(F.split(p, r"(?i)\s+as\s+"), -1))),
        )

    return let(
        stmts,
        lambda ss: F.struct(
            F.flatten(F.transform(ss, functions)).alias("functions"),
            F.filter(F.transform(ss, lambda s: F.regexp_extract(s, rf"\*\s+as\s+({IDENT})", 1)), lambda n: n != "").alias("namespaces"),
        ),
    )


def is_trusted_call(text: Column, validators: Column) -> Column:
    return let(text, lambda t: _is_trusted_call(t, validators))


def _is_trusted_call(text: Column, validators: Column) -> Column:
    callee = F.regexp_replace(F.regexp_extract(text, rf"\A\s*({IDENT}(?:\s*\.\s*{IDENT})?)\s*\(", 1), r"\s+", "")
    parts = F.split(callee, r"\.")
    by_member = (
        (F.size(parts) == 2)
        & F.array_contains(validators["namespaces"], F.get(parts, F.lit(0)))
        & F.get(parts, F.lit(1)).rlike(java(fv.VALIDATOR_NAME))
    )
    inline = text.rlike(java(fv.INLINE_CHECK_METHOD)) & text.rlike(java(fv.INLINE_CHECK_WORDS))
    return F.coalesce(F.array_contains(validators["functions"], callee) | by_member | inline, F.lit(False))


def joined(text: Column) -> Column:
    """Member chains that a formatter broke over lines, on one line."""
    return F.regexp_replace(text, r"\s*\n\s*(\??\.)", "$1")


def is_user_controlled(text: Column, tainted: Column | None = None) -> Column:
    direct = joined(text).rlike(java(fv.USER_INPUT))
    return direct if tainted is None else direct | _mentions(text, tainted)


def is_outbound_http(callee: Column) -> Column:
    return callee.rlike(java(fv.OUTBOUND_CALLEE))


def is_static_url(arg: Column) -> Column:
    return F.trim(arg).rlike(java(fv.STATIC_URL))


def file_taint(f: Source) -> Column:
    """struct<tainted, validated, dynamic, validators, calls> of one file."""

    def solve(s):
        marked = F.transform(
            s["assigns"],
            lambda a: F.struct(
                a["names"].alias("names"), words(a["value"]).alias("reads"),
                joined(a["value"]).rlike(java(fv.USER_INPUT)).alias("direct"),
                (a["declared"] & is_trusted_call(a["value"], s["validators"])).alias("checked"),
                a["value"].rlike(r"\[[\s\S]+\]").alias("indexed"),
            ),
        )

        def expand(rows):
            return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r["names"], lambda n: F.struct(n.alias("name"), r["reads"].alias("reads"))))))

        def with_marks(m):
            open_ = F.filter(m["m"], lambda r: ~r["checked"])
            seeds = F.flatten(F.transform(F.filter(open_, lambda r: r["direct"]), lambda r: r["names"]))
            tainted = fixpoint(seeds, expand(open_), lambda e, names: F.arrays_overlap(e["reads"], names))

            def finish(t):
                def reached(r):
                    return r["direct"] | F.arrays_overlap(r["reads"], t["t"])

                checked = F.flatten(
                    F.transform(F.filter(m["m"], lambda r: r["checked"] & reached(r)), lambda r: r["names"])
                )
                in_checks = F.flatten(
                    F.transform(
                        F.filter(s["calls"], lambda c: is_trusted_call(c["text"], s["validators"])),
                        lambda c: F.array_intersect(words(c["text"]), t["t"]),
                    )
                )
                dynamic = F.flatten(F.transform(F.filter(m["m"], lambda r: r["indexed"] & reached(r)), lambda r: r["names"]))
                return F.struct(
                    t["t"].alias("tainted"), F.array_distinct(F.concat(checked, in_checks)).alias("validated"),
                    dynamic.alias("dynamic"), s["validators"].alias("validators"), s["calls"].alias("calls"),
                )

            return let(F.struct(tainted.alias("t")), finish)

        return let(F.struct(marked.alias("m")), with_marks)

    state = F.struct(f.spans["assigns"].alias("assigns"), trusted_validators(f.code).alias("validators"), f.spans["calls"].alias("calls"))
    return let(state, solve)


def ssrf(f: Source) -> Column:
    """User-controlled URL reaches an outbound call.

    Any point where taint leaves what can be proved in the file (dynamic
    dispatch, imported or unknown function) replaces all rows of that file by
    ``ambiguous-ast`` rows.
    """
    from riskspark.operators.secrets import import_names

    def rows(t):
        def stop(c):
            root = F.regexp_extract(c["callee"], rf"\A({IDENT})", 1)
            parts = F.split(c["callee"], r"\.")
            imported = F.array_contains(t["imports"], c["callee"]) | (
                (F.size(parts) == 2) & F.array_contains(t["imports"], F.get(parts, F.lit(0)))
            )
            passes = (
                ~c["callee"].rlike(java(fv.IMMUTABLE_CALLEE)) & ~is_outbound_http(c["callee"])
                & ~is_trusted_call(c["text"], t["s"]["validators"]) & is_user_controlled(c["args"], t["s"]["tainted"])
                & ~c["callee"].rlike(java(fv.NON_MUTATING_CALLEE))
            )
            reason = (
                F.when(c["callee"].contains("[") & is_user_controlled(c["callee"], t["s"]["tainted"]), "dynamic-dispatch")
                .when(F.array_contains(t["s"]["dynamic"], root), "dynamic-dispatch")
                .when(passes & imported, "inter-procedural-boundary")
                .when(passes, "complex-aliasing")
            )
            evidence = (
                F.when(c["callee"].contains("[") & is_user_controlled(c["callee"], t["s"]["tainted"]), F.lit("tainted dynamic dispatch"))
                .when(F.array_contains(t["s"]["dynamic"], root), F.concat(F.lit("tainted dynamic dispatch via "), root))
                .when(passes & imported, F.concat(F.lit("tainted value passed into imported function "), c["callee"]))
                .otherwise(F.concat(F.lit("tainted object passed into unknown function "), c["callee"]))
            )
            return F.struct(reason.alias("reason"), evidence.alias("evidence"), c["line"].alias("line"))

        stops = F.filter(F.transform(t["s"]["calls"], stop), lambda x: x["reason"].isNotNull())

        def hit(c):
            checked = is_trusted_call(c["first"], t["s"]["validators"]) | _mentions(c["first"], t["s"]["validated"])
            return (
                is_outbound_http(c["callee"]) & (c["first"] != "") & ~is_static_url(c["first"]) & ~checked
                & is_user_controlled(c["first"], t["s"]["tainted"])
            )

        def weak(c):
            about = F.filter(
                t["near"], lambda n: F.regexp_extract(n, rf"(?:\.test|\.has|\.includes)\s*\(\s*({IDENT})", 1) == c["first"]
            )
            return c["first"].rlike(rf"\A{IDENT}\z") & F.exists(about, lambda n: ~is_trusted_call(n, t["s"]["validators"]))

        def output(st):
            ambiguous = F.transform(
                st["st"],
                lambda x: finding(
                    rule_id="ambiguous-ast", severity="warning", state="AMBIGUOUS", line=x["line"], message=fv.MSG_AMBIGUOUS,
                    evidence=x["evidence"], ambiguity_reason=x["reason"], requires_deep=True,
                ),
            )
            found = F.transform(
                F.filter(t["s"]["calls"], hit),
                lambda c: finding(
                    rule_id="ssrf", severity="high", line=c["line"], message=F.when(weak(c), fv.MSG_SSRF_WEAK).otherwise(fv.MSG_SSRF),
                    evidence=sc.collapse_ws(c["text"]), requires_deep=True,
                ),
            )
            return F.when(F.size(st["st"]) > 0, ambiguous).otherwise(found)

        return let(F.struct(stops.alias("st")), output)

    near = F.regexp_extract_all(f.code, F.lit(rf"(?<=[;\n]|^)[^;\n]*(?:\.test|\.has|\.includes)\s*\(\s*{IDENT}[^;\n]*"), F.lit(0))
    state = F.struct(file_taint(f).alias("s"), import_names(f.code).alias("imports"), near.alias("near"))
    guard = (
        pf.is_source(f.path) & pf.ssrf_target(f.path, f.content) & f.content.rlike("(?i)req|searchparams|formdata")
        & joined(f.content).rlike(java(fv.USER_INPUT))
    )
    return when(guard, let(state, rows), lexer.CALLS)


# --- release gate variants ------------------------------------------------------------------

GATE_ROW = "struct<line:int,issue:string,severity:string>"


#: One of the gate's rules may fire.
GATE_GUARD = r"(?i)\b(?:exec|spawn)|updateBillingPlan|updateProfile|updateAccount|deleteAccount|transferOwnership|UPDATE\s"


def _gate_row(line, issue, severity="HARD_BLOCK"):
    return F.struct(line.alias("line"), issue.alias("issue"), F.lit(severity).alias("severity"))


def _no_gate_rows():
    return F.expr(f"cast(array() as array<{GATE_ROW}>)")


def gate_command_injection(f: Source) -> Column:
    """Request variable -> literal + variable -> exec/spawn."""
    req_p, cmd_p, exec_p = java(fv.GATE_REQUEST_VAR), java(fv.GATE_COMMAND_BUILD), java(fv.GATE_EXEC)
    commands = let(
        F.regexp_extract_all(f.content, F.lit(req_p), F.lit(1)),
        lambda req: F.transform(
            F.filter(
                F.regexp_extract_all(f.content, F.lit(cmd_p), F.lit(0)), lambda m: F.array_contains(req, F.regexp_extract(m, cmd_p, 2))
            ),
            lambda m: F.regexp_extract(m, cmd_p, 1),
        ),
    )
    found = let(
        commands,
        lambda cs: F.transform(
            F.filter(find_all(f.content, exec_p), lambda h: F.array_contains(cs, F.regexp_extract(h["text"], exec_p, 1))),
            lambda h: _gate_row(
                h["line"], F.concat(F.lit("Command injection risk: user-controlled input flows into "), F.trim(h["text"]), F.lit("."))
            ),
        ),
    )
    return F.when(pf.is_source(f.path) & f.content.rlike(r"(?i)\b(?:exec|spawn)"), found).otherwise(_no_gate_rows())


def route_blocks(content: Column) -> Column:
    """router.post/put/patch/delete calls and exported mutation handlers."""
    return F.concat(find_all(content, java(fv.ROUTE_BLOCK)), find_all(content, java(fv.EXPORTED_ROUTE)))


def gate_bola(f: Source) -> Column:
    """Account data changed under a caller-supplied id with no guard word in the block."""

    def unguarded(b):
        return b.rlike(java(fv.GATE_USER_ID)) & ~b.rlike(java(fv.GATE_AUTH_GUARD))

    by_route = F.transform(
        F.filter(
            route_blocks(f.content),
            lambda h: (h["text"].rlike(java(fv.BILLING_UPDATE)) | h["text"].rlike(java(fv.GATE_MUTATION_CALL))) & unguarded(h["text"]),
        ),
        lambda h: _gate_row(h["line"], F.lit(fv.MSG_BOLA_ROUTE)),
    )
    by_call = F.transform(
        F.filter(find_all(f.content, java(fv.ACCOUNT_MUTATION)), lambda h: unguarded(tx.block_text(f.content, f.spans["blocks"], h["start"]))),
        lambda h: _gate_row(h["line"], F.lit(fv.MSG_BOLA_CALL)),
    )
    guard = f.content.rlike(r"(?i)updateBillingPlan|updateProfile|updateAccount|deleteAccount|transferOwnership|UPDATE\s")
    return F.when(pf.is_source(f.path) & guard, F.concat(by_route, by_call)).otherwise(_no_gate_rows())


# --- server-only code in client files ----------------------------------------------------------

def architectural_leak(f: Source) -> Column:
    """Client file whose function uses names imported from server-only modules; one per function."""
    stmts = F.filter(
        F.regexp_extract_all(f.code, F.lit(r"(?<![\w$.])import\s+[^;'\"]*?\s+from\s*['\"][^'\"]+['\"]"), F.lit(0)),
        lambda s: let(
            F.regexp_extract(s, r"['\"]([^'\"]+)['\"]", 1),
            lambda m: m.isin(fv.SERVER_ONLY_MODULES) | m.rlike(java(fv.BACKEND_MODULE_PATH)),
        ),
    )
    names = F.array_except(
        F.flatten(F.transform(stmts, lambda s: words(F.regexp_replace(s, r"['\"][^'\"]*['\"]", " ")))),
        F.array(*[F.lit(w) for w in ("import", "from", "as", "type")]),
    )

    def rows(server):
        uses = F.filter(
            find_all(f.bare, rf"(?<![\w$.]){IDENT}(?=\s*(?:\??\.|\())"), lambda u: F.array_contains(server, u["text"])
        )

        def containers(fs):
            owner = F.transform(
                uses, lambda u: F.array_max(F.filter(fs, lambda x: (x["start"] <= u["start"]) & (u["start"] < x["end"])))
            )
            return F.array_distinct(F.filter(owner, lambda o: o.isNotNull()))

        return F.transform(
            let(F.transform(f.spans["functions"], lambda x: F.struct(x["start"], x["line"], x["end"], x["name"])), containers),
            lambda o: finding(
                rule_id="architectural-leak", severity="high", line=o["line"], message=fv.MSG_LEAK, evidence=o["name"],
                fix=F.struct(
                    F.lit("scaffold-server-action").alias("kind"), F.lit(None).cast("string").alias("credential_id"),
                    F.lit(None).cast("string").alias("replacement"), F.lit(None).cast("string").alias("expected_text"),
                    tx.byte_offset(f.content, o["start"]).cast("int").alias("start_byte"),
                    tx.byte_offset(f.content, o["end"]).cast("int").alias("end_byte"),
                    F.substring(f.content, o["start"] + 1, o["end"] - o["start"]).alias("raw_snippet"),
                ),
            ),
        )

    # the directive must be code, not a comment
    directive = f.code.rlike(r"(?m)^\s*['\"]use client['\"]\s*;?\s*$")
    return when(pf.is_source(f.path) & f.content.contains("use client"), F.when(directive, let(names, rows)).otherwise(none()), lexer.FUNCTIONS)


INJECTION_RULES = [ssrf, sql_injection, command_injection, path_traversal, auth_bypass, architectural_leak]
