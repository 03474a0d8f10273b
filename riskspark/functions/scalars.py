"""Scalar functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskspark import fixed_values as fv
from riskspark.functions.regex import any_of, java
from riskspark.functions.text import let


_BLANKS = " \t\n\r\f\u000b\u00a0\ufeff\u2028\u2029"


def trim(c) -> Column:
    """Strip the same characters ECMAScript's trim does, not only spaces."""
    return F.trim(c, F.lit(_BLANKS))


def blank_to_null(c: Column) -> Column:
    """'' and all-blank text count as missing."""
    t = trim(c)
    return F.when(t != "", t)


def first_match(value: Column, rows) -> Column:
    """Ordered patterns: result of the first (pattern, result) that matches, else NULL."""
    out = None
    for pattern, result in rows:
        cond = value.rlike(java(pattern))
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out


def unquote(s: Column) -> Column:
    return F.regexp_replace(trim(s), "^['\"`]|['\"`]\\z", "")


def credential_id(v: Column) -> Column:
    return let(v, lambda x: first_match(x, [(p, i) for i, _, p, _ in fv.CREDENTIALS]))


def credential_label(v: Column) -> Column:
    return let(v, lambda x: first_match(x, [(p, label) for _, label, p, _ in fv.CREDENTIALS]))


def credential_replacement(v: Column) -> Column:
    return let(v, lambda x: first_match(x, [(p, r) for _, _, p, r in fv.CREDENTIALS]))


def jwt_role(s: Column) -> Column:
    """``role`` (else ``iss``) of an unverified JWT payload."""
    payload = F.get(F.split(s, r"\."), F.lit(1))
    role = let(
        base64_text(F.translate(payload, "-_", "+/")),
        lambda t: F.coalesce(
            F.nullif(F.get_json_object(t, "$.role"), F.lit("")), F.nullif(F.get_json_object(t, "$.iss"), F.lit(""))
        ),
    )
    return F.when(s.rlike(java(fv.JWT_SHAPE)), role)


def base64_text(plain: Column) -> Column:
    """UTF-8 text of unpadded base64, NULL if malformed."""
    return let(
        plain,
        lambda p: F.try_to_binary(F.rpad(p, (F.ceil(F.length(p) / 4) * 4).cast("int"), "="), F.lit("base64")).cast("string"),
    )


def secret_label(v: Column) -> Column:
    """What kind of secret a literal holds: credential, service-role text, service-role JWT."""
    return let(
        v,
        lambda x: F.when(
            x.rlike(maybe_secret()),
            F.coalesce(
                credential_label(x),
                first_match(x, list(zip(fv.SERVICE_ROLE_TEXT, fv.SERVICE_ROLE_LABELS))),
                F.when(jwt_role(x) == "service_role", F.lit("supabase service_role JWT")),
            ),
        ),
    )


def maybe_secret() -> str:
    """One cheap pattern that every secret literal matches; used as a guard."""
    return any_of([p for _, _, p, _ in fv.CREDENTIALS] + fv.SERVICE_ROLE_TEXT + [r"eyJ"])


# literal heads of the secret patterns, one of which every match contains
_SECRET_HEADS = ["AKIA", "sk_", "sk-", "ghp_", "github_pat_", "xox", "AIza", "SG.", "postgres://", "eyJ"]


def secret_guard(content: Column) -> Column:
    """Necessary condition for :func:`maybe_secret`, made of substring tests."""
    out = F.lit(False)
    for head in _SECRET_HEADS:
        out = out | content.contains(head)
    return out | content.rlike("SK[a-z0-9]{32}") | content.rlike("(?i)service[_-]?role")


def env_token(name: Column) -> Column:
    snake = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    snake = F.regexp_replace(F.regexp_replace(snake, "[^A-Za-z0-9]+", "_"), "^_+|_+\\z", "")
    return F.upper(snake)


def env_reference(name: Column) -> Column:
    return F.when(env_token(name) != "", F.concat(F.lit("process.env."), env_token(name)))


def norm_identifier_part(part: Column) -> Column:
    """Full scan: drop quotes, fold case."""
    return F.lower(F.regexp_replace(part, '^"|"\\z', ""))


def norm_sql_identifier(name: Column) -> Column:
    """``schema.table`` with default schema public, lower case, unquoted."""
    parts = F.split(F.regexp_replace(name, r"\s+", ""), r"\.")
    return F.when(
        F.size(parts) > 1, F.concat_ws(".", norm_identifier_part(F.get(parts, F.lit(0))), norm_identifier_part(F.get(parts, F.lit(1))))
    ).otherwise(F.concat(F.lit("public."), norm_identifier_part(F.get(parts, F.lit(0)))))


def gate_table_name(name: Column) -> Column:
    """Gate variant: names as written, quoted parts keep their case, no default schema."""
    return F.array_join(
        F.transform(
            F.split(F.regexp_replace(name, r"\s+", ""), r"\."),
            lambda p: F.when(p.startswith('"') & p.endswith('"'), F.replace(F.regexp_replace(p, '^"|"\\z', ""), F.lit('""'), F.lit('"'))).otherwise(F.lower(p)),
        ),
        ".",
    )


def sql_literal(text: Column) -> Column:
    """struct<type, num, str, raw> of a static SQL literal, NULL otherwise."""
    return let(trim(text), _sql_literal)


def _sql_literal(t: Column) -> Column:
    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")

    def lit(kind, num, str_, raw):
        return F.struct(F.lit(kind).alias("type"), num.alias("num"), str_.alias("str"), raw.alias("raw"))

    inner = F.regexp_replace(t, r"^['\"]|['\"]\z", "")
    return (
        F.when(t.rlike(r"^\d+(?:\.\d+)?\z"), lit("number", t.try_cast("double"), none_str, t))
        .when(t.rlike(r"(?i)^(?:true|false)\z"), lit("boolean", F.lower(t).eqNullSafe("true").cast("double"), none_str, F.lower(t)))
        .when(t.rlike(r"^'(?:''|[^'])*+'\z"), lit("string", none_num, F.replace(inner, F.lit("''"), F.lit("'")), t))
        .when(t.rlike(r'^"(?:[^"]|"")*+"\z'), lit("string", none_num, F.replace(inner, F.lit('""'), F.lit('"')), t))
    )


_NUMBER, _PLAIN = r"\d{1,9}(?:\.\d{1,5})?", r"'[\w.-]*'"


def static_predicate(predicate: Column) -> Column:
    """Evidence text when both sides are same-typed literals and the comparison is true.

    ``predicate`` is read several times; bind a costly one with ``let``.
    """
    p, has = predicate, lambda c: F.contains(predicate, F.lit(c))
    both = lambda kind: p.rlike(rf"^{kind} *(?:=|<>|!=|>=|<=|>|<) *{kind}\z")
    # plain literals hold neither an operator nor a blank, and a quote sorts before all that stands in such a string
    signs = F.translate(p, "<>!", "===")
    left, right = F.rtrim(F.substring_index(signs, "=", 1)), F.ltrim(F.substring_index(signs, "=", -1))
    number = F.substring(F.lit("<=>"), (F.signum(left.cast("double") - right.cast("double")) + 2).cast("int"), F.lit(1))
    string = F.when(left == right, "=").when(left < right, "<").otherwise(">")

    def verdict(order: Column) -> Column:
        """A comparison is true if its operator has the sign of the sides' order."""
        same = ~has("<") & ~has(">") & ~has("!") & (left == right)
        return _evidence(F.when(has("!"), order != "=").otherwise(F.contains(p, order)), same)

    return F.when(both(_NUMBER), verdict(number)).when(both(_PLAIN), verdict(string)).otherwise(let(trim(p), _any_predicate))


def _evidence(holds: Column, same: Column) -> Column:
    return F.when(holds, F.when(same, F.lit("tautological RLS predicate")).otherwise(F.lit("statically true RLS predicate")))


def _any_predicate(t: Column) -> Column:
    cmp = java(fv.STATIC_COMPARISON)

    def parts(t: Column) -> Column:
        return F.struct(
            sql_literal(F.regexp_extract(t, cmp, 1)).alias("l"),
            F.regexp_extract(t, cmp, 2).alias("op"),
            sql_literal(F.regexp_extract(t, cmp, 3)).alias("r"),
        )

    def judge(x: Column) -> Column:
        num = x["l"]["type"] != "string"
        left, right, op = x["l"], x["r"], x["op"]
        eq = F.when(num, left["num"] == right["num"]).otherwise(left["str"] == right["str"])
        gt = F.when(num, left["num"] > right["num"]).otherwise(left["str"] > right["str"])
        lt = F.when(num, left["num"] < right["num"]).otherwise(left["str"] < right["str"])
        holds = (
            F.when(op == "=", eq).when(op.isin("<>", "!="), ~eq).when(op == ">", gt)
            .when(op == ">=", gt | eq).when(op == "<", lt).when(op == "<=", lt | eq)
        )
        return _evidence((left["type"] == right["type"]) & holds, (op == "=") & (left["raw"] == right["raw"]))

    # a literal starts with a digit, a quote, or true/false
    return F.when(t.rlike(r"(?i)^['\"\dtf]") & t.rlike(cmp), let(parts(t), judge))


def version_class(v: Column) -> Column:
    """struct<severity, issue> for an unpinned dependency version, NULL if pinned."""
    n = F.lower(trim(v))

    def out(sev, pre, post):
        return F.struct(F.lit(sev).alias("severity"), F.concat(F.lit(pre), v, F.lit(post)).alias("issue"))

    return (
        F.when(n.isin("*", "latest"), out("critical", "uses '", "', which is completely unpinned."))
        .when(n.rlike(r"(^|[.\-])x(\z|[.\-])") | n.contains("*"), out("critical", "uses wildcard version '", "'."))
        .when(n.rlike(r"^[\^~><=]") | n.rlike(r"\s+-\s+") | n.contains("||"), out("warning", "uses unpinned range '", "'."))
    )


# --- severity and state mappings: three different ones, on purpose -------------

def norm_severity(s: Column) -> Column:
    u = F.upper(trim(F.coalesce(s, F.lit(""))))
    return F.when(u.isin("WARNING", "WARN"), "MEDIUM").when(u.isin(fv.SEVERITIES), u).otherwise("INFO")


def infer_state(state: Column, severity: Column, requires_deep: Column) -> Column:
    """Client mapping: unknown becomes GREEN."""
    s = F.upper(trim(F.coalesce(state, F.lit(""))))
    sev = norm_severity(severity)
    return (
        F.when(s.isin(fv.STATES), s).when(sev == "CRITICAL", "RED")
        .when((sev == "HIGH") | F.coalesce(requires_deep, F.lit(False)), "YELLOW").otherwise("GREEN")
    )


def norm_state(state: Column) -> Column:
    """Ingest mapping: unknown becomes YELLOW."""
    s = F.upper(trim(state))
    return F.when(s.isin(fv.STATES), s).otherwise("YELLOW")


def state_for(state: Column, severity: Column) -> Column:
    """Dashboard mapping over stored state and severity."""
    return (
        F.when((state == "RED") | (severity == "CRITICAL"), "RED")
        .when((state == "YELLOW") | severity.isin("HIGH", "MEDIUM"), "YELLOW")
        .otherwise("GREEN")
    )


# --- repositories, organizations, licenses ---------------------------------------

def parse_remote(url: Column, fold_host: bool = True) -> Column:
    """struct<host, owner, repo, remote_url> of an scp-like or URL remote, NULL if neither."""
    u = trim(url)
    scp = r"(?i)^git@([^:]+):([^/]+)/(.+?)(?:\.git)?\z"
    web = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)"
    segments = F.filter(F.split(F.regexp_extract(u, web, 2), "/"), lambda s: s != "")

    def out(host, owner, repo):
        h = F.lower(host) if fold_host else host
        return F.struct(
            h.alias("host"), owner.alias("owner"), F.regexp_replace(repo, r"(?i)\.git\z", "").alias("repo"), u.alias("remote_url")
        )

    return (
        F.when(u.rlike(scp), out(F.regexp_extract(u, scp, 1), F.regexp_extract(u, scp, 2), F.regexp_extract(u, scp, 3)))
        .when(
            u.rlike(web) & (F.size(segments) >= 2),
            out(F.regexp_extract(u, web, 1), F.get(segments, F.lit(0)), F.get(segments, F.size(segments) - 1)),
        )
    )


def owner_is_org(flag: Column, owner: Column, personal: Column) -> Column:
    """Control plane: flagged, or an owner that is not the personal account."""
    differs = (F.lower(owner) != F.lower(personal)) & (owner != "") & (personal != "")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(differs, F.lit(False))


def looks_like_org(owner: Column, personal: Column) -> Column:
    o, p = F.lower(trim(F.coalesce(owner, F.lit("")))), F.lower(trim(F.coalesce(personal, F.lit(""))))
    return F.when(o == "", F.lit(False)).when(p != "", o != p).otherwise(F.coalesce(owner, F.lit("")).rlike(java(fv.ORG_OWNER)))


def license_tier(text: Column) -> Column:
    t = blank_to_null(text)
    return F.when(t.rlike(java(fv.TEAM_TIER)), "teams").when(t.rlike(java(fv.SOLO_TIER)), "solo").otherwise(F.lower(t))


def first_tier(*candidates: Column) -> Column:
    return F.coalesce(*[license_tier(c) for c in candidates], F.lit("pro"))


def beta_key_date(key: Column, prefix: str = "RISK-BETA-") -> Column:
    """Creation date in ``<prefix>yyyyMMdd-<suffix>``; NULL for other shapes and impossible dates."""
    k = trim(key)
    digits = F.regexp_extract(k, "^" + prefix.replace("-", "\\-") + r"(\d{8})-[^-]*\z", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def hash_token(t: Column) -> Column:
    return F.sha2(trim(t), 256)


# --- text ---------------------------------------------------------------------------

def redact(text: Column, tag: str = "") -> Column:
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for _, _, pattern, stem in fv.DIFF_SECRETS:
        out = F.regexp_replace(out, java(pattern), stem.format(tag=tag))
    return out


def utf8_prefix(text: Column, n: Column) -> Column:
    return F.substring(F.encode(text, "UTF-8"), F.lit(1), n).cast("string")


def truncate_utf8(text: Column, n: Column, marker: str = "\n[truncated context]") -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) <= n, t).otherwise(F.concat(utf8_prefix(t, n), F.lit(marker)))


def compact_diff(text: Column, max_bytes: int = fv.DIFF_BYTES) -> Column:
    """Headers, hunk marks and changed lines only, cut to a byte budget."""
    kept = F.filter(F.split(text, r"\r?\n", -1), lambda l: l.rlike(r"^(?:diff --git |--- |\+\+\+ |@@ |\+(?!\+\+)|-(?!--))"))
    joined = trim(F.array_join(kept, "\n"))
    chosen = F.when(joined != "", joined).otherwise(trim(text))
    return F.when(F.octet_length(chosen) <= max_bytes, chosen).otherwise(utf8_prefix(chosen, F.lit(max_bytes)))


def collapse_ws(text: Column) -> Column:
    return trim(F.regexp_replace(text, java(r"\s+"), " "))


def decode_b64(call: Column) -> Column:
    """Decoded text of atob('…') / Buffer.from('…', 'base64').toString(), NULL otherwise."""
    t = trim(call)
    atob = java(r"^atob\s*\(\s*([\"'`])([A-Za-z0-9+/=_-]+)\1\s*\)$")
    buf = java(
        r"^Buffer\s*\.\s*from\s*\(\s*([\"'`])([A-Za-z0-9+/=_-]+)\1\s*,\s*([\"'`])(base64url|base64)\3\s*\)"
        r"\s*\.\s*toString\s*\(\s*(?:([\"'`])(?:utf-?8|ascii|latin1)\5\s*)?\)$"
    )
    payload = F.when(t.rlike(atob), F.regexp_extract(t, atob, 2)).when(t.rlike(buf), F.regexp_extract(t, buf, 2))
    return base64_text(F.regexp_replace(F.translate(payload, "-_", "+/"), "=+\\z", ""))


def infer_vuln_type(issues: Column) -> Column:
    return (
        F.when(issues.rlike(r"(?i)command injection|exec|spawn|shell"), "COMMAND_INJECTION")
        .when(issues.rlike(r"(?i)BOLA|authorization bypass|authorization guard|account-scoped|tenant"), "AUTH_BYPASS")
        .when(issues.rlike(r"(?i)Stripe|secret|API key|credential|token"), "HARDCODED_SECRET")
        .when(issues.rlike(r"(?i)syntax|parser|parse"), "SYNTAX_ERROR")
        .when(issues.rlike(r"(?i)SQL|query|injection"), "SQL_INJECTION")
        .otherwise("FAST_CHECK_REMEDIATION")
    )


def extract_code(text: Column) -> Column:
    t = trim(text)
    fence = r"```(?:[A-Za-z0-9_-]+)?\r?\n([\s\S]*?)```"
    fenced = blank_to_null(F.regexp_extract(t, fence, 1))
    rest = trim(F.regexp_replace(t, r"(?i)\ARoot Cause:\s*[^\r\n]*\r?\n?", ""))
    return F.coalesce(fenced, trim(F.regexp_replace(rest, r"\A```[A-Za-z0-9_-]*\s*|\s*```\z", "")))


def response_text(body: Column) -> Column:
    """First usable field of a remediation response: code, diff, first text block, raw body."""

    def first_truthy(names):  # the first non-empty field is chosen before blankness is tested
        return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{n}"), F.lit("")) for n in names])

    def usable(c):
        return F.when(trim(c) != "", c)

    blocks = F.filter(
        F.from_json(F.get_json_object(body, "$.content"), "array<struct<text:string>>"),
        lambda b: trim(F.coalesce(b["text"], F.lit(""))) != "",
    )
    return F.coalesce(
        usable(first_truthy(["code", "patchedCode", "replacement", "sourceCode"])),
        usable(first_truthy(["patch", "diff"])),
        trim(F.get(blocks, F.lit(0))["text"]),
        trim(body),
    )


# --- subscriptions ----------------------------------------------------------------------

def metadata_first(maps: list[Column], keys: list[str]) -> Column:
    """First non-blank value: all keys of the first map, then of the next."""
    return F.coalesce(*[blank_to_null(F.try_element_at(m, F.lit(k))) for m in maps for k in keys])


def sub_tier(ids: Column, metadata_tier: Column, solo_id: str, teams_id: str) -> Column:
    t = F.lower(metadata_tier)
    return (
        F.when(F.array_contains(ids, teams_id), "teams").when(F.array_contains(ids, solo_id), "solo")
        .when(t.isin("teams", "team"), "teams").when(t.isin("solo", "pro"), "solo")
    )


def sub_seats(tier: Column, seats: Column, quantity: Column, default: int = 1) -> Column:
    n = F.coalesce(seats, quantity, F.lit(default))
    return F.when(tier == "solo", F.lit(1)).when(n > 0, n).otherwise(F.lit(default))


def sub_status(status: Column) -> Column:
    return F.when(status.isin("active", "trialing", "incomplete"), "ACTIVE").otherwise("REVOKED")


# --- alerts ----------------------------------------------------------------------------------

def line_from_trail(trail: Column) -> Column:
    """First ``:<digits>`` of the first trail entry that has one."""
    nums = F.transform(trail, lambda t: F.nullif(F.regexp_extract(t, r":(\d+)(?!\w)", 1), F.lit("")))
    return F.get(F.array_compact(nums), F.lit(0)).try_cast("int")


def absolute_path(root: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.regexp_replace(root, "/+\\z", ""), path))


def node_kind(t: Column) -> Column:
    """Raw syntax node type to one of 16 kinds; the first rule that matches wins."""
    return (
        F.when(t == "program", "PROGRAM")
        .when(t.isin("identifier", "shorthand_property_identifier"), "IDENTIFIER")
        .when(t == "property_identifier", "PROPERTY_IDENTIFIER")
        .when(t == "call_expression", "CALL_EXPRESSION")
        .when(t.isin("member_expression", "subscript_expression"), "MEMBER_EXPRESSION")
        .when(t == "variable_declarator", "VARIABLE_DECLARATOR")
        .when(t.isin("assignment_expression", "augmented_assignment_expression"), "ASSIGNMENT")
        .when(t.rlike("function|method|arrow_function"), "FUNCTION")
        .when(t.isin("formal_parameter", "required_parameter", "optional_parameter"), "PARAMETER")
        .when(t == "return_statement", "RETURN")
        .when(t.isin("if_statement", "ternary_expression"), "IF")
        .when(t.rlike(r"^(?:for|while|do)_statement\z"), "LOOP")
        .when(t.rlike("string|number|true|false|null|undefined|template_string"), "LITERAL")
        .when(t.isin("object", "object_pattern"), "OBJECT")
        .when(t.isin("array", "array_pattern"), "ARRAY")
        .otherwise("UNKNOWN")
    )


def classify_sink(kind: Column, text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (
        F.when((kind == "command-execution") | text.rlike(java(r"(?i)\b(?:exec|execSync|spawn|spawnSync|execFile)\s*\(")), "COMMAND_INJECTION")
        .when((kind == "file-system") | text.rlike(java(r"(?i)\b(?:readFile|writeFile|createReadStream|unlink)\s*\(")), "PATH_TRAVERSAL")
        .when((kind == "auth-boundary") | text.rlike("(?i)auth|role|session|permission|admin"), "AUTH_BYPASS")
        .when(
            (kind == "raw-sql-construction")
            | text.rlike(java(r"(?i)\b(?:sql|select|insert|update|delete|rpc|supabase)\b"))
            | text.rlike(java(r"(?i)\b(?:db|pool|client|connection|database)\s*\.\s*(?:query|execute)\s*\(")),
            "SQL_INJECTION",
        )
        .otherwise("UNKNOWN_TAINT")
    )


def format_trail(trail: Column) -> Column:
    """array<struct<path,line,text>> to ``path:line -> text`` entries."""
    return F.transform(
        trail,
        lambda n: F.concat(
            F.when(n["line"].isNull(), n["path"]).otherwise(F.concat_ws(":", n["path"], n["line"].cast("string"))),
            F.lit(" -> "),
            collapse_ws(n["text"]),
        ),
    )
