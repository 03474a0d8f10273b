"""Secret rules over string literals, identifiers and folded constants.

String literals, client calls and static text come from the lexer: strings
inside ``${}`` of a template are seen, quotes in a regular expression open no
string, and a name means the innermost block that declares it.  Known loss
against a syntax tree: parameters and other variables hide no constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import fixed_values as fv
from riskspark.functions import lexer, paths as pf, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import IDENT, STRING, find_all, let
from riskspark.operators.findings import Source, finding, text_fix, when

DECLARED = rf"(?<![\w$.])(?:const|let|var)\s+({IDENT})\s*(?::[^=;\n(){{}}]*+)?=\s*({STRING})(?=\s*(?:[;,)}}\n]|\z))"
ASSIGNED = rf"(?<=[\n;{{}}]|^)[ \t]*+(?:[A-Za-z_$][\w$]*\s*\.\s*)*+({IDENT})(?:\s+=\s*|\s*=\s+)({STRING})(?=\s*(?:[;,)}}\n]|\z))"


def needs_client(path: Column) -> Column:
    return pf.is_frontend(path) & ~pf.is_backend_api(path)


def in_credential_scope(f: Source) -> Column:
    return pf.is_source(f.path) & (~needs_client(f.path) | pf.is_client_component(f.path, f.content))


def frontend_message(f: Source) -> Column:
    return F.when(needs_client(f.path), fv.MSG_FRONTEND_CLIENT).otherwise(fv.MSG_FRONTEND_SOURCE)


def string_literals(f: Source, keep) -> Column:
    """Quoted strings with positions."""
    return F.filter(f.spans["strings"], lambda h: keep(h["text"]))


def credential_hits(f: Source) -> Column:
    """String literals that hold a credential, service-role text or service-role JWT."""

    def build(calls: Column) -> Column:
        def inside(s, key_args):
            return F.exists(
                calls,
                lambda c: (s["start"] > c["start"]) & (s["start"] < c["end"])
                & ((s["start"] >= c["first_end"]) if key_args else (s["start"] < c["first_end"])),
            )

        hits = string_literals(f, lambda t: t.rlike(sc.maybe_secret()))
        found = F.transform(
            hits, lambda h: F.struct(h.alias("h"), sc.secret_label(sc.unquote(h["text"])).alias("label"))
        )
        found = F.filter(
            found,
            lambda x: x["label"].isNotNull()
            & ~(inside(x["h"], False) & pf.is_local_dev_url(sc.unquote(x["h"]["text"])))
            & ~(pf.is_backend_api(f.path) & inside(x["h"], True)),
        )

        def one(x: Column) -> Column:
            value = sc.unquote(x["h"]["text"])
            fix = text_fix(
                f.content, x["h"]["start"], x["h"]["text"], credential_id=sc.credential_id(value),
                replacement=sc.credential_replacement(value),
            )
            return finding(
                rule_id="frontend-secret", severity="critical", line=x["h"]["line"], message=frontend_message(f),
                evidence=x["label"], fix=let(fix, lambda v: F.when(v["credential_id"].isNotNull(), v)),
            )

        return F.transform(found, one)

    guard = sc.secret_guard(f.content) & in_credential_scope(f)
    return when(guard, build(f.spans["clients"]), lexer.STRINGS | lexer.CLIENTS)


def service_role_identifiers(f: Source) -> Column:
    """Identifiers named like a service-role key."""
    hits = find_all(f.bare, rf"(?<![\w$]){tx.WORDS}", lambda t: t.rlike(java(fv.SERVICE_ROLE_NAME)))
    found = F.transform(
        hits,
        lambda h: finding(
            rule_id="frontend-secret", severity="critical", line=h["line"], message=frontend_message(f),
            evidence="Supabase service role reference",
        ),
    )
    return when(in_credential_scope(f) & f.content.rlike(r"(?i)service[_-]?role"), found)


def _secret_assignments(f: Source) -> Column:
    """struct<name, value_start, raw, line> of secret-named variables given one plain literal."""

    def rows(pattern):
        return F.transform(
            find_all(f.code, pattern, lambda t: t.rlike(java(fv.SECRET_NAME))),
            lambda h: let(
                F.struct(
                    F.regexp_extract(h["text"], pattern, 1).alias("name"),
                    F.regexp_extract(h["text"], f"({STRING})\\z", 1).alias("raw"),
                ),
                lambda g: F.struct(
                    g["name"].alias("name"),
                    (h["start"] + F.length(h["text"]) - F.length(g["raw"])).alias("start"),
                    g["raw"].alias("raw"),
                    (h["line"] + tx.newlines(F.left(h["text"], F.length(h["text"]) - F.length(g["raw"])))).alias("line"),
                ),
            ),
        )

    both = F.concat(rows(DECLARED), rows(ASSIGNED))
    return F.filter(both, lambda r: r["name"].rlike(java(fv.SECRET_NAME)) & (r["raw"] != ""))


def _local_url_names(f: Source) -> Column:
    """Identifiers that are the first argument of createClient."""
    return F.transform(f.spans["clients"], lambda c: F.trim(F.get(c["args"], F.lit(0))["text"]))


def named_secret_literals(f: Source, rule_id: str, message: Column, include_known: bool, scope: Column) -> Column:
    def build(local_names: Column) -> Column:
        def kept(r):
            value = sc.unquote(r["raw"])
            local = F.array_contains(local_names, r["name"]) & pf.is_local_dev_url(value)
            return ~local if include_known else ~local & sc.secret_label(value).isNull()

        def one(r):
            value = sc.unquote(r["raw"])
            fix = text_fix(
                f.content, r["start"], r["raw"], credential_id=sc.credential_id(value),
                replacement=F.coalesce(sc.credential_replacement(value), sc.env_reference(r["name"])),
            )
            return finding(
                rule_id=rule_id, severity="critical", line=r["line"], message=message,
                evidence=F.concat(r["name"], F.lit(" assigned a hardcoded literal")),
                fix=let(fix, lambda x: F.when(x["replacement"].isNotNull(), x)),
            )

        return F.transform(F.filter(_secret_assignments(f), kept), one)

    assigned = f.content.rlike(rf"(?i)(?:key|secret|token|password)[\w$]*\s*(?::[^=;\n]*)?=\s*['\"]")
    return when(scope & assigned, let(_local_url_names(f), build), lexer.CLIENTS)


def named_secrets_frontend(f: Source) -> Column:
    return named_secret_literals(f, "frontend-secret", frontend_message(f), False, in_credential_scope(f))


def named_secrets_backend(f: Source) -> Column:
    scope = pf.is_source(f.path) & pf.is_backend_api(f.path)
    return named_secret_literals(f, "backend-secret", F.lit(fv.MSG_NAMED_BACKEND), True, scope)


# --- constant folding ----------------------------------------------------------------

def folded_secrets(f: Source) -> Column:
    """Secrets hidden by concatenation, array join, templates or base64."""
    def at_call(x):
        return F.exists(f.spans["clients"], lambda c: (x["start"] > c["start"]) & (x["start"] < c["end"]) & (x["start"] >= c["first_end"]))

    found = F.filter(f.spans["folds"], lambda x: x["value"].rlike(sc.maybe_secret()))
    labelled = F.transform(found, lambda x: F.struct(x.alias("x"), sc.secret_label(x["value"]).alias("label")))
    kept = F.filter(labelled, lambda r: r["label"].isNotNull() & ~(pf.is_backend_api(f.path) & at_call(r["x"])))
    rows = F.transform(
        kept,
        lambda r: finding(
            rule_id="frontend-secret", severity="critical", line=r["x"]["line"], message=frontend_message(f), evidence=r["label"]),
    )
    c = f.content
    guard = (c.contains("+") | c.contains("`") | c.contains("atob") | c.contains("Buffer") | c.rlike(r"\.\s*join\s*\(")) & in_credential_scope(f)
    return when(guard, rows, lexer.FOLDS | lexer.CLIENTS)


# --- backend ---------------------------------------------------------------------------

def jwt_hardcoded(f: Source) -> Column:
    found = F.transform(
        find_all(f.code, java(fv.JWT_CALL)),
        lambda h: finding(
            rule_id="backend-secret", severity="critical", line=h["line"], message=fv.MSG_JWT,
            evidence=F.concat(F.lit("jwt."), F.regexp_extract(h["text"], r"^jwt\.(sign|verify)", 1), F.lit(" hardcoded secret")),
        ),
    )
    return when(pf.is_source(f.path) & f.content.contains("jwt."), found)


def database_urls(f: Source) -> Column:
    def kept(t):
        v = sc.unquote(t)
        return v.rlike(java(fv.DATABASE_URL)) & (F.coalesce(sc.credential_id(v), F.lit("")) != "postgres-uri")

    found = F.transform(
        string_literals(f, kept),
        lambda h: finding(
            rule_id="backend-secret", severity="critical", line=h["line"], message=fv.MSG_DATABASE_URL,
            evidence="database connection string",
        ),
    )
    return when(pf.is_source(f.path) & f.content.contains("://"), found, lexer.STRINGS)


def import_names(code: Column) -> Column:
    """Local names bound by import statements."""
    stmts = F.regexp_extract_all(code, F.lit(r"(?<![\w$.])(import\s+[^;'\"]*?\s+from)(?=\s*['\"])"), F.lit(1))

    def names(s):
        star = F.regexp_extract(s, rf"\*\s+as\s+({IDENT})", 1)
        default = F.regexp_extract(s, rf"^import\s+(?!type\s+\{{)({IDENT})\s*(?:,|\s+from)", 1)
        named = F.transform(
            F.split(F.regexp_extract(s, r"\{([^}]*)\}", 1), ","),
            lambda p: F.trim(F.element_at(F.split(F.trim(p), r"(?i)\s+as\s+"), -1)),
        )
        return F.concat(F.array(star, default), named)

    return F.filter(F.flatten(F.transform(stmts, names)), lambda n: n.rlike(rf"\A{IDENT}\z"))


def client_key_args(f: Source) -> Column:
    """createClient key arguments that carry a secret, directly or through constants.

    An imported key cannot be resolved here and is reported (fails safe).
    """

    def build(imports: Column) -> Column:
        def judge(a):
            secret = F.get(F.filter(a["values"], lambda v: sc.secret_label(v).isNotNull()), F.lit(0))
            imported = F.exists(a["reads"], lambda r: F.array_contains(imports, r))
            evidence = let(
                secret,
                lambda value: F.when(value.rlike(r"(?i)service[_-]?role"), "Supabase service role key passed to createClient")
                .when(value.isNotNull(), sc.secret_label(value))
                .when(imported, "Unresolved imported createClient key"),
            )
            return F.struct(evidence.alias("evidence"), a["line"].alias("line"))

        keys = F.flatten(F.transform(f.spans["clients"], lambda c: F.slice(c["args"], F.lit(2), F.size(c["args"]))))
        return F.transform(
            F.filter(F.transform(keys, judge), lambda j: j["evidence"].isNotNull()),
            lambda r: finding(
                rule_id="backend-secret", severity="critical", line=r["line"], message=fv.MSG_CLIENT_KEY, evidence=r["evidence"]
            ),
        )

    guard = pf.is_source(f.path) & pf.is_backend_api(f.path) & f.content.contains("createClient")
    return when(guard, let(import_names(f.code), build), lexer.CLIENTS)


def service_role_jsx_prop(f: Source) -> Column:
    """A client built with a service-role key is handed to a component prop."""
    made = F.filter(
        f.spans["assigns"],
        lambda a: a["declared"] & (F.size(a["names"]) == 1) & a["value"].rlike(rf"\A(?:await\s+)?(?:{IDENT}\s*\.\s*)?createClient\s*\("))
    admins = F.transform(
        F.filter(
            made,
            lambda a: F.exists(F.concat(a["names"], tx.words(a["value"])), lambda w: w.rlike(java(fv.SERVICE_ROLE_NAME)))
            | a["value"].rlike(r"(?i)(?:^|[^A-Za-z0-9])service[_-]?role"),
        ),
        lambda a: F.get(a["names"], F.lit(0)),
    )
    prop = rf"(?<=[\s])[A-Za-z_][\w-]*\s*=\s*\{{\s*({IDENT})\s*\}}"
    found = let(
        admins,
        lambda names: F.transform(
            F.filter(find_all(f.code, prop), lambda h: F.array_contains(names, F.regexp_extract(h["text"], r"\{\s*([A-Za-z_$][\w$]*)\s*\}", 1))),
            lambda h: finding(
                rule_id="frontend-secret", severity="critical", line=h["line"], message=fv.MSG_JSX_PROP,
                evidence="Supabase service role client passed as JSX prop",
            ),
        ),
    )
    return when(pf.is_source(f.path) & pf.is_frontend(f.path) & f.content.contains("createClient"), found, lexer.CALLS)


# --- text mode -------------------------------------------------------------------------

NAMED_LITERAL = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*\"([^\"\n]*)\""


def named_secret_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line mode for any text: one row per ``name = "literal"`` whose name looks secret."""
    hits = F.regexp_extract_all("text", F.lit(f"({NAMED_LITERAL})"), F.lit(1))
    return (
        lines.where(F.col("text").contains('"') & F.col("text").contains("=") & F.col("text").rlike(NAMED_LITERAL))
        .select(*keys, "line", F.posexplode(hits).alias("k", "hit"))
        .select(
            *keys, "line", "k",
            F.regexp_extract("hit", NAMED_LITERAL, 1).alias("name"), F.regexp_extract("hit", NAMED_LITERAL, 2).alias("literal"),
        )
        .where(F.col("name").rlike(java(fv.SECRET_NAME)) & sc.secret_label(F.col("literal")).isNull())
    )


FRONTEND_RULES = [credential_hits, folded_secrets, service_role_identifiers, named_secrets_frontend]
BACKEND_RULES = [jwt_hardcoded, client_key_args, database_urls, named_secrets_backend]
