"""Queries over raw text and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import corpus, fixed_values as fv
from riskspark.catalog.common import events, files, query, table
from riskspark.functions import paths as pf, scalars as sc, text as tx
from riskspark.operators import dataflow, lexical, post, score, secrets, sqlrls
from riskspark.operators.findings import finding
from riskspark.session import spread

_LINES = "SELECT doc_id, source, CAST(i AS INTEGER) AS line, lines[i] AS text FROM (SELECT doc_id, source, regexp_split_to_array(text, '\\r?\\n') AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)"
_HITS = f"SELECT doc_id, source, line, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*=\\s*\"([^\"\\n]*)\"', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*=\\s*\"([^\"\\n]*)\"', 2)) AS literal FROM ({_LINES})"
_NAMED = f"SELECT * FROM ({_HITS}) WHERE regexp_matches(name, '(?i)key|secret|token|password')"


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


def _named(spark, sf):
    return secrets.named_secret_lines(lexical.lines(_docs(spark, sf), "text", "doc_id", "source"), ["doc_id", "source"])


@query("named_secret_hits", f"SELECT doc_id, line, name, literal FROM ({_NAMED})")
def named_secret_hits(spark, sf):
    return _named(spark, sf).select("doc_id", "line", "name", "literal")


def secret_scores(spark, sf):
    hits = _named(spark, sf)
    row = finding(rule_id="frontend-secret", severity="critical", line=F.col("line"), evidence=F.concat("name", F.lit(" assigned a hardcoded literal")))
    found = hits.select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.col("k").cast("bigint").alias("seq"), row.alias("f")).select("repo_id", "path", "seq", "f.*")
    return score.tri_state(post.dedupe_findings(found), _docs(spark, sf).select(F.col("source").alias("repo_id")))


@query("secret_tri_state", f"WITH h AS (SELECT DISTINCT source, doc_id, line, name FROM ({_NAMED})), s AS (SELECT DISTINCT source FROM documents) SELECT s.source AS repo_id, CASE WHEN count(h.doc_id) > 0 THEN 'Hard Block' ELSE 'Likely Safe' END AS score, count(h.doc_id) AS findings FROM s LEFT JOIN h USING (source) GROUP BY 1")
def secret_tri_state(spark, sf):
    return secret_scores(spark, sf)


@query("ci_tri_state", f"WITH h AS ({_NAMED}), s AS (SELECT DISTINCT source FROM documents) SELECT s.source AS repo_id, CASE WHEN count(h.doc_id) > 0 THEN 'CONFIRMED FINDING' ELSE 'LIKELY SAFE' END AS score FROM s LEFT JOIN h USING (source) GROUP BY 1")
def ci_tri_state(spark, sf):
    found = _named(spark, sf).select(F.col("source").alias("repo_id"), F.lit("High").alias("severity"))
    return score.ci_tri_state(found, _docs(spark, sf).select(F.col("source").alias("repo_id")))


@query("text_lines", f"SELECT doc_id, count(*) AS lines, max(length(text)) AS longest, count(*) FILTER (text = '') AS blank FROM ({_LINES}) GROUP BY 1")
def text_lines(spark, sf):
    return lexical.lines(_docs(spark, sf), "text", "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count_if(F.col("text") == "").alias("blank")
    )


@query("text_matches", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS matches, len(regexp_extract(text, '^([^0-9]*)[0-9]', 1)) AS first_offset, 1 + len(regexp_extract(text, '^([^0-9]*)[0-9]', 1)) - len(replace(regexp_extract(text, '^([^0-9]*)[0-9]', 1), chr(10), '')) AS first_line FROM documents WHERE regexp_matches(text, '[0-9]')")
def text_matches(spark, sf):
    m = lexical.matches(_docs(spark, sf), r"[0-9]+", "text", "doc_id")
    return m.groupBy("doc_id").agg(
        F.count("*").alias("matches"), F.min("offset").cast("bigint").alias("first_offset"), F.min("line").cast("bigint").alias("first_line")
    )


@query("text_positions", "SELECT doc_id, len(text) // 2 AS off, 1 + len(left(text, len(text) // 2)) - len(replace(left(text, len(text) // 2), chr(10), '')) AS line, strlen(left(text, len(text) // 2)) AS bytes FROM documents")
def text_positions(spark, sf):
    d = _docs(spark, sf).withColumn("off", F.expr("length(text) div 2"))
    off = F.col("off").cast("int")
    return d.select("doc_id", "off", tx.line_at(F.col("text"), off).cast("bigint").alias("line"), tx.byte_offset(F.col("text"), off).cast("bigint").alias("bytes"))


_REDACT_SQL = r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(t, '\bsk_(?:live|test)_[A-Za-z0-9_=-]{8,}\b', 'STRIPE_SECRET_REDACTED', 'g'), '\bsk-proj-[A-Za-z0-9_-]{20,}\b', 'sk-proj_REDACTED', 'g'), '\b(?:ghp|github_pat)_[A-Za-z0-9_]{30,}\b', 'github_pat_REDACTED', 'g')) AS digest
FROM (SELECT conv_id, turn, text || ' sk_live_' || lpad(CAST(conv_id AS VARCHAR), 12, 'a') || ' x ghp_' || lpad(CAST(turn AS VARCHAR), 36, 'b') || ' sk-proj-' || repeat('c', 20 + turn) || '. sk_test_short' AS t FROM conversations)"""


@query("redact_text", _REDACT_SQL)
def redact_text(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.concat(
        "text", F.lit(" sk_live_"), F.lpad(F.col("conv_id").cast("string"), 12, "a"), F.lit(" x ghp_"), F.lpad(F.col("turn").cast("string"), 36, "b"),
        F.lit(" sk-proj-"), F.repeat(F.lit("c"), (20 + F.col("turn")).cast("int")), F.lit(". sk_test_short"),
    )
    return c.select("conv_id", "turn", F.md5(sc.redact(t)).alias("digest"))


@query("credential_labels", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'AWS Access Key ID' WHEN 1 THEN 'Stripe Secret Key' WHEN 2 THEN 'GitHub Personal Access Token' WHEN 3 THEN 'Slack Bot/User Token' WHEN 4 THEN 'Google Cloud / Maps API Key' WHEN 5 THEN 'supabase service_role JWT' WHEN 6 THEN 'PostgreSQL Connection URI' END AS label FROM documents")
def credential_labels(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 8
    ident = F.lpad(F.col("doc_id").cast("string"), 35, "0")
    jwt = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.translate(F.base64(F.encode(F.lit('{"role":"service_role","x":1}'), "UTF-8")), "+/=", "-_"), F.lit(".sig"))
    secret = (
        F.when(k == 0, F.concat(F.lit("AKIA"), F.right(ident, F.lit(16)))).when(k == 1, F.concat(F.lit("sk_test_"), ident)).when(k == 2, F.concat(F.lit("ghp_a"), ident))
        .when(k == 3, F.concat(F.lit("xoxb-"), F.right(ident, F.lit(10)), F.lit("-abc"))).when(k == 4, F.concat(F.lit("AIza"), ident)).when(k == 5, jwt)
        .when(k == 6, F.lit("postgres://u:p@h:1/d")).otherwise("sk_test_no")
    )
    clean = F.regexp_replace("text", "[^A-Za-z]+", " ")
    value = F.when(k == 5, secret).otherwise(F.concat(clean, F.lit(" "), secret))
    return d.select("doc_id", sc.secret_label(value).alias("label"))


@query("jwt_roles", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'service_role' WHEN 1 THEN 'anon' WHEN 2 THEN c_name END AS role FROM customer")
def jwt_roles(spark, sf):
    k = F.col("c_custkey") % 4
    body = F.when(k == 0, F.lit('{"role":"service_role"}')).when(k == 1, F.lit('{"role":"anon","iss":"x"}')).when(k == 2, F.concat(F.lit('{"iss":"'), "c_name", F.lit('"}'))).otherwise(F.lit("{}"))
    token = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.translate(F.base64(F.encode(body, "UTF-8")), "+/=", "-_"), F.lit(".sig"))
    return table(spark, sf, "customer").select("c_custkey", sc.jwt_role(token).alias("role"))


@query("env_names", "SELECT p_partkey, 'process.env.' || upper(replace(trim(p_name), ' ', '_')) || '_ID_' || p_partkey AS ref FROM part")
def env_names(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", sc.env_reference(F.concat(F.lit("--"), F.replace(F.trim("p_name"), F.lit(" "), F.lit("--")), F.lit("-id"), F.lit("."), F.col("p_partkey").cast("string"))).alias("ref")
    )


@query("unquoted", "SELECT s_suppkey, s_name AS v FROM supplier")
def unquoted(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", sc.unquote(F.concat(F.lit("  '"), "s_name", F.lit("` "))).alias("v"))


@query("truncated_text", "SELECT doc_id, strlen(text) <= 400 AS whole, length(text) AS chars, CASE WHEN strlen(text) <= 400 THEN md5(text) END AS digest FROM documents")
def truncated_text(spark, sf):
    """Texts within the budget are unchanged; longer ones end in the marker and fit."""
    t = sc.truncate_utf8(F.col("text"), F.lit(400), marker="[cut]")
    whole = ~t.endswith("[cut]")
    return table(spark, sf, "documents").select(
        "doc_id", (whole & (F.octet_length(t) <= 405)).alias("whole"), F.length("text").cast("bigint").alias("chars"), F.when(whole, F.md5(t)).alias("digest")
    )


@query("collapsed_text", r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '[\s\x{00A0}\x{FEFF}]+', ' ', 'g'))) AS digest FROM conversations")
def collapsed_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(sc.collapse_ws(F.col("text"))).alias("digest"))


@query("compact_diffs", "SELECT conv_id, 'diff --git a/f b/f' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-old ' || conv_id || chr(10) || '+new ' || turn AS compact, turn FROM conversations")
def compact_diffs(spark, sf):
    c = table(spark, sf, "conversations")
    ctx = F.replace(F.concat(F.lit(" "), "text"), F.lit("\n"), F.lit("\n "))
    d = F.concat(F.lit("diff --git a/f b/f\n@@ -1 +1 @@\n"), ctx, F.lit("\n-old "), F.col("conv_id").cast("string"), F.lit("\n+new "), F.col("turn").cast("string"), F.lit("\n"))
    return c.select("conv_id", "turn", sc.compact_diff(d, 10_000_000).alias("compact"))


@query("decoded_base64", "SELECT s_suppkey, s_name AS v FROM supplier")
def decoded_base64(spark, sf):
    b = F.base64(F.encode("s_name", "UTF-8"))
    call = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('atob("'), b, F.lit('")'))).otherwise(
        F.concat(F.lit("Buffer.from('"), F.translate(b, "+/=", "-_"), F.lit("', 'base64url').toString('utf8')"))
    )
    return table(spark, sf, "supplier").select("s_suppkey", sc.decode_b64(call).alias("v"))


@query("local_urls", "SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 2 AS local FROM pages")
def local_urls(spark, sf):
    k = F.col("page_id") % 4
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    u = F.when(k == 0, F.concat(F.lit("http://localhost:3000/"), rest)).when(k == 1, F.concat(F.lit("http://localhost@"), rest)).when(k == 2, F.lit("127.0.0.1:54321")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", pf.is_local_dev_url(u).alias("local"))


@query("sql_literals", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' END AS type, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN 1.0 END AS num, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority || '''s' END AS str FROM orders")
def sql_literals(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).when(k == 1, F.lit("TRUE")).when(k == 2, F.concat(F.lit("'"), "o_orderpriority", F.lit("''s'"))).otherwise("owner_id")
    v = sc.sql_literal(t)
    return table(spark, sf, "orders").select("o_orderkey", v["type"].alias("type"), v["num"].alias("num"), v["str"].alias("str"))


@query("static_predicates", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = l_linenumber THEN 'tautological RLS predicate' END AS eq, CASE WHEN l_quantity > l_linenumber THEN 'statically true RLS predicate' END AS gt, CASE WHEN l_returnflag <> l_linestatus THEN 'statically true RLS predicate' END AS ne FROM lineitem")
def static_predicates(spark, sf):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    s = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", sc.static_predicate(F.concat(q, F.lit(" = "), n)).alias("eq"), sc.static_predicate(F.concat(q, F.lit(">"), n)).alias("gt"),
        sc.static_predicate(F.concat(s("l_returnflag"), F.lit(" <> "), s("l_linestatus"))).alias("ne"),
    )


@query("version_classes", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' WHEN 3 THEN 'warning' WHEN 4 THEN 'warning' END AS severity FROM part")
def version_classes(spark, sf):
    k, n = F.col("p_size") % 6, F.col("p_size").cast("string")
    v = F.when(k == 0, F.lit(" Latest ")).when(k == 1, F.concat(n, F.lit(".x"))).when(k == 2, F.concat(F.lit("^"), n, F.lit(".0.0"))).when(k == 3, F.concat(n, F.lit(" - 99"))).when(k == 4, F.concat(n, F.lit(" || 7"))).otherwise(F.concat(n, F.lit(".2.0-exact")))
    return table(spark, sf, "part").select("p_partkey", sc.version_class(v)["severity"].alias("severity"))


@query("sql_identifiers", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'public.' || lower(n_name) ELSE 'shop.' || lower(n_name) END AS full_scan, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'Shop.' || n_name END AS gate FROM nation")
def sql_identifiers(spark, sf):
    """Spaces are dropped by both; only the full scan folds quoted names and adds the schema."""
    clean = F.regexp_replace("n_name", r"\s+", "")
    raw = F.when(F.col("n_nationkey") % 2 == 0, clean).otherwise(F.concat(F.lit('"Shop" . "'), clean, F.lit('"')))
    n = table(spark, sf, "nation").withColumn("raw", raw)
    return n.select("n_nationkey", sc.norm_sql_identifier(F.col("raw")).alias("full_scan"), sc.gate_table_name(F.col("raw")).alias("gate"))


@query("stripped_sql", r"SELECT doc_id, md5('select 1' || chr(10) || 'from t ' || '') AS digest FROM documents")
def stripped_sql(spark, sf):
    """Any text in comments disappears; what is left is the same for every document."""
    line = F.concat(F.lit("-- "), F.regexp_replace("text", r"[\r\n]", " "))
    block = F.concat(F.lit("/*"), F.replace("text", F.lit("*/"), F.lit("")), F.lit("*/"))
    sql = F.concat(F.lit("select 1"), line, F.lit("\nfrom t "), block)
    return table(spark, sf, "documents").select("doc_id", F.md5(sqlrls.strip_sql_comments(sql)).alias("digest"))


# --- paths ---------------------------------------------------------------------------------------------

@query("path_classes", f"""SELECT repo_id, path, CASE WHEN path LIKE 'app/api/%' THEN 'app-api' WHEN path LIKE 'app/%' THEN 'frontend' ELSE 'other' END AS route_class,
  regexp_matches(path, '\\.(js|jsx|ts|tsx)$') AS source, regexp_matches(path, '\\.(js|jsx|ts|tsx|sql)$') AS scannable, regexp_matches(path, '\\.(js|ts|tsx)$') AND path NOT LIKE '%.test.js' AS tree,
  path LIKE 'supabase/migrations/%.sql' AS migration, path LIKE '%package.json' AS manifest, NOT path LIKE '%.test.js' AND regexp_matches(path, '\\.(js|ts|tsx)$') AS watched
FROM ({corpus.files_sql(columns='repo_id, path')})""")
def path_classes(spark, sf):
    p = F.col("path")
    return files(spark, sf).select(
        "repo_id", "path", pf.route_class(p).alias("route_class"), pf.is_source(p).alias("source"), pf.is_scannable(p).alias("scannable"), pf.in_source_tree(p).alias("tree"),
        pf.is_migration(p).alias("migration"), pf.is_manifest(p).alias("manifest"), pf.watch_source(p).alias("watched"),
    )


_CLIENT = ", ".join(str(corpus.index_of(n)) for n in ("admin client prop", "server code in client", "re-exported secret", "wildcard secret"))


@query("client_components", corpus.files_sql(f"k IN ({_CLIENT}) AND path LIKE 'app/%'", "repo_id, path"))
def client_components(spark, sf):
    return files(spark, sf).where(pf.is_client_component(F.col("path"), F.col("content"))).select("repo_id", "path")


@query("ssrf_targets", corpus.files_sql("path LIKE 'app/api/%'", "repo_id, path"))
def ssrf_targets(spark, sf):
    return files(spark, sf).where(pf.ssrf_target(F.col("path"), F.col("content"))).select("repo_id", "path")


# --- small classifiers ---------------------------------------------------------------------------------------

@query("node_kinds", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'PROGRAM' WHEN 1 THEN 'IDENTIFIER' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'LOOP' WHEN 4 THEN 'LITERAL' WHEN 5 THEN 'ASSIGNMENT' ELSE 'UNKNOWN' END AS kind FROM events")
def node_kinds(spark, sf):
    names = F.array(*[F.lit(x) for x in ("program", "identifier", "method_definition", "while_statement", "template_string", "augmented_assignment_expression", "comment")])
    return events(spark, sf).select("event_id", sc.node_kind(F.get(names, F.col("event_id") % 7)).alias("kind"))


@query("sink_types", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'COMMAND_INJECTION' WHEN 1 THEN 'PATH_TRAVERSAL' WHEN 2 THEN 'AUTH_BYPASS' WHEN 3 THEN 'SQL_INJECTION' ELSE 'UNKNOWN_TAINT' END AS vuln_type, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 1 END AS payloads, CASE event_id % 5 WHEN 0 THEN 'command-execution' WHEN 1 THEN 'file-system' WHEN 2 THEN 'auth-boundary' WHEN 3 THEN 'critical-call' END AS sink_kind FROM events")
def sink_types(spark, sf):
    ident = F.col("event_id").cast("string")
    names = F.array(*[F.lit(x) for x in ("spawn(", "fs.unlink(", "hasRole(", "pool.query(", "render(")])
    text = F.concat(F.get(names, F.col("event_id") % 5), F.lit("v"), ident, F.lit(")"))
    kind = dataflow.sink_kind(F.lit("call_expression"), text)
    vt = sc.classify_sink(kind, text)
    return events(spark, sf).select("event_id", vt.alias("vuln_type"), F.size(dataflow.payloads_for(vt)).alias("payloads"), kind.alias("sink_kind"))


@query("entry_keys", "SELECT event_id, 'id' || user_id || ',get,name,' || event_type AS keys FROM events")
def entry_keys(spark, sf):
    text = F.concat(F.lit("merge(req.query.id"), F.col("user_id").cast("string"), F.lit(", req.body['name'], searchParams.get(\""), "event_type", F.lit('"))'))
    return events(spark, sf).select("event_id", F.array_join(dataflow.entry_keys(text), ",").alias("keys"))


@query("payload_survival", "SELECT event_id, event_type = 'error' AS survives FROM events")
def payload_survival(spark, sf):
    e = F.col("event_type")
    src = F.array(F.lit("req.query.id"), F.lit("id"))
    sink = F.when(e == "error", 'db.query("SELECT " + id)').when(e == "click", 'db.query("SELECT $1", [id])').when(e == "view", "db.query(sanitize(id))").otherwise("render(id)")
    texts = F.concat(src, F.array(sink))
    typ = F.when(e.isin("purchase", "signup"), "PATH_TRAVERSAL").otherwise("SQL_INJECTION")
    return events(spark, sf).select("event_id", dataflow.payload_survives(typ, texts, sink).alias("survives"))


@query("trails", "SELECT event_id, 'a' || user_id || '.ts:' || (event_id % 90 + 1) || ' -> x = y|b.ts -> call(z)' AS trail, CAST(event_id % 90 + 1 AS INTEGER) AS line FROM events")
def trails(spark, sf):
    n = (F.col("event_id") % 90 + 1).cast("int")
    t = F.array(
        F.struct(F.concat(F.lit("a"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), n.alias("line"), F.lit(" x  =\n y ").alias("text")),
        F.struct(F.lit("b.ts").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("call(z)").alias("text")),
    )
    shown = sc.format_trail(t)
    return events(spark, sf).select("event_id", F.array_join(shown, "|").alias("trail"), sc.line_from_trail(shown).alias("line"))


@query("vulnerability_types", "SELECT event_id, CASE event_type WHEN 'error' THEN 'COMMAND_INJECTION' WHEN 'click' THEN 'AUTH_BYPASS' WHEN 'view' THEN 'HARDCODED_SECRET' WHEN 'purchase' THEN 'SQL_INJECTION' ELSE 'FAST_CHECK_REMEDIATION' END AS kind FROM events")
def vulnerability_types(spark, sf):
    e = F.col("event_type")
    issue = F.when(e == "error", "flows into spawn(").when(e == "click", "crosses the Tenant border").when(e == "view", "a Stripe value").when(e == "purchase", "raw query").otherwise("other")
    return events(spark, sf).select("event_id", sc.infer_vuln_type(issue).alias("kind"))


@query("extracted_code", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'run(' || conv_id || ')' ELSE 'plain ' || turn END AS code FROM conversations")
def extracted_code(spark, sf):
    c = table(spark, sf, "conversations")
    clean = F.replace("text", F.lit("`"), F.lit(""))
    fenced = F.concat(clean, F.lit("\n```ts\nrun("), F.col("conv_id").cast("string"), F.lit(")\n```\nmore"))
    plain = F.concat(F.lit("Root Cause: "), F.regexp_replace("text", r"[\r\n`]", " "), F.lit("\nplain "), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", sc.extract_code(F.when(F.col("turn") % 2 == 0, fenced).otherwise(plain)).alias("code"))


@query("response_texts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code ' || user_id WHEN 1 THEN 'diff ' || user_id WHEN 2 THEN 'block ' || user_id ELSE 'raw ' || user_id END AS text FROM events")
def response_texts(spark, sf):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    body = (
        F.when(k == 0, F.concat(F.lit('{"patchedCode":"code '), u, F.lit('","diff":"x"}'))).when(k == 1, F.concat(F.lit('{"code":"  ","diff":"diff '), u, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"content":[{"text":" "},{"text":" block '), u, F.lit(' "}]}'))).otherwise(F.concat(F.lit(" raw "), u, F.lit(" ")))
    )
    return events(spark, sf).select("event_id", sc.response_text(body).alias("text"))


@query("hard_blocks", "SELECT event_id, event_type IN ('error','click') AS hard, CASE event_type WHEN 'error' THEN 'offline' WHEN 'click' THEN 'deep' ELSE 'unsupported' END AS lane FROM events")
def hard_blocks(spark, sf):
    e = F.col("event_type")
    sev = F.when(e == "error", "critical").when(e == "click", "HARD_BLOCK").otherwise("warning")
    lane = post.fix_lane(F.when(e == "click", "llm-reasoning").otherwise("x"), F.when(e == "error", "credential"), e == "click")
    return events(spark, sf).select("event_id", post.is_hard_block(sev).alias("hard"), lane.alias("lane"))


@query("valid_verdicts", "SELECT event_id, event_type IN ('click','view','error') AS valid FROM events")
def valid_verdicts(spark, sf):
    e = F.col("event_type")
    v = events(spark, sf).select(
        "event_id", F.when(e == "click", "RED").when(e == "view", "YELLOW").when(e == "error", "GREEN").when(e == "signup", "RED").otherwise("BLUE").alias("state"),
        F.concat(F.lit("because "), F.col("user_id").cast("string")).alias("reasoning"), F.when(e.isin("view", "signup"), "run it").alias("manual_qa_line"), F.when(e.isin("click", "signup"), "--- a").alias("auto_patch"),
    )
    return post.validate_verdicts(v).select("event_id", F.col("error").isNull().alias("valid"))


@query("valid_patches", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'src/f' || user_id || '.ts' END AS clean_path FROM events")
def valid_patches(spark, sf):
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    p = events(spark, sf).select(
        "event_id", F.when(e == "click", F.concat(F.lit(" src\\f"), u, F.lit(".ts "))).when(e == "view", F.lit("../x")).when(e == "error", F.lit("/abs")).otherwise("ok.ts").alias("file_path"),
        F.when(e == "purchase", "rename").otherwise("update").alias("action"), F.when(e != "signup", "x").alias("new_content"),
    )
    return post.validate_patches(p).select("event_id", "clean_path")


@query("ambiguity_diffs", "SELECT event_id, 'diff --git a/' || user_id || ' b/' || user_id || chr(10) || '+++ b/' || user_id || chr(10) || '+// AST_STATE=AMBIGUOUS line=1 reason=' || event_type || chr(10) || '+// Local AST proof surrendered.' AS diff FROM events")
def ambiguity_diffs(spark, sf):
    f = events(spark, sf).select(
        F.col("event_id").cast("string").alias("repo_id"), F.col("user_id").cast("string").alias("path"), F.lit("ambiguous-ast").alias("rule_id"), F.lit("AMBIGUOUS").alias("state"),
        F.lit(None).cast("int").alias("line"), F.col("event_type").alias("ambiguity_reason"), F.lit(None).cast("string").alias("evidence"),
    )
    return post.ambiguity_diff(f).select(F.col("repo_id").cast("bigint").alias("event_id"), "diff")


@query("identity_union", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'u' || c_custkey WHEN 1 THEN 'v' || c_custkey END AS user_ref FROM customer")
def identity_union(spark, sf):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    meta = F.create_map(F.lit("userId"), F.lit("  "), F.lit("user_id"), F.when(k == 0, F.concat(F.lit(" u"), n)))
    custom = F.create_map(F.lit("userId"), F.when(k != 2, F.concat(F.lit("v"), n)))
    return table(spark, sf, "customer").select("c_custkey", sc.metadata_first([meta, custom], ["userId", "user_id"]).alias("user_ref"))


# --- ranges, fixes, verdicts on large key sets ---------------------------------------------------------------------

@query("overlapping_ranges", "SELECT l_orderkey, s AS start_byte, e AS end_byte, p AS previous_end FROM (SELECT l_orderkey, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) * 10 AS e, lag(l_partkey % 1000 + CAST(l_quantity AS BIGINT) * 10) OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 1000, l_partkey % 1000 + CAST(l_quantity AS BIGINT) * 10) AS p FROM lineitem) WHERE s < p")
def overlapping_ranges(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).alias("start_byte"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("bigint") * 10).alias("end_byte"))
    return post.overlapping_fixes(l, ["l_orderkey"])


@query("dedupe_fixes", "SELECT count(*) AS fixes FROM (SELECT DISTINCT l_returnflag, l_shipdate, l_linenumber, l_quantity, l_linestatus FROM lineitem)")
def dedupe_fixes(spark, sf):
    f = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("repo_id"), F.col("l_shipdate").cast("string").alias("path"), F.lit("credential").alias("kind"), F.col("l_linenumber").alias("start_byte"),
        F.col("l_quantity").cast("int").alias("end_byte"), F.col("l_linestatus").alias("expected_text"), F.lit("x").alias("replacement"),
    )
    return post.dedupe_fixes(f).agg(F.count("*").alias("fixes"))


@query("patch_conflicts", "WITH p AS (SELECT l_orderkey, l_partkey % 500 AS f FROM lineitem), b AS (SELECT DISTINCT l_orderkey FROM p WHERE f < 25) SELECT count(*) FILTER (l_orderkey IN (SELECT l_orderkey FROM b)) AS conflicting, count(*) FILTER (l_orderkey NOT IN (SELECT l_orderkey FROM b)) AS applicable FROM p")
def patch_conflicts(spark, sf):
    l = table(spark, sf, "lineitem").select(F.lit("r").alias("repo_id"), F.col("l_orderkey").alias("patch_set"), (F.col("l_partkey") % 500).alias("file_path"))
    done = l.where(F.col("file_path") < 25).select("repo_id", F.col("file_path").alias("path"))
    ok, bad = post.patch_conflicts(l, done)
    count = lambda df, n: df.agg(F.count("*").alias(n))
    both = count(bad, "conflicting").select("conflicting", F.lit(0).cast("bigint").alias("applicable")).unionByName(count(ok, "applicable").select(F.lit(0).cast("bigint").alias("conflicting"), "applicable"))
    return both.agg(F.sum("conflicting").alias("conflicting"), F.sum("applicable").alias("applicable"))


@query("merge_verdicts", "SELECT CAST(o_custkey AS VARCHAR) AS repo_id, CASE o_custkey % 5 WHEN 1 THEN 'VULNERABLE' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'PATCH' ELSE 'none' END AS state, CASE o_custkey % 5 WHEN 1 THEN 'critical' WHEN 3 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN o_custkey % 5 = 4 THEN count(*) ELSE 1 END AS rows FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey")
def merge_verdicts(spark, sf):
    o = table(spark, sf, "orders")
    row = finding(rule_id="ambiguous-ast", severity="warning", line=F.lit(1), evidence=F.col("o_orderkey").cast("string"))
    found = o.select(F.col("o_custkey").cast("string").alias("repo_id"), F.lit("a.ts").alias("path"), F.col("o_orderkey").alias("seq"), row.alias("f")).select("repo_id", "path", "seq", "f.*")
    k = F.col("o_custkey") % 5
    verdicts = o.select("o_custkey").distinct().where(k != 4).select(
        F.col("o_custkey").cast("string").alias("repo_id"), F.when(k == 0, "GREEN").when(k == 1, "red").when(k == 2, "YELLOW").alias("state"), F.lit("because").alias("reasoning"),
        F.lit(None).cast("string").alias("manual_qa_line"), F.lit(None).cast("string").alias("auto_patch"), F.when(k == 3, 2).alias("patch_count"), F.lit("fixes").alias("explanation"),
    )
    out = post.merge_verdicts(found, verdicts)
    return out.groupBy("repo_id", F.coalesce("state", F.lit("none")).alias("state"), "severity").agg(F.count("*").alias("rows"))


@query("context_budget", "WITH s AS (SELECT source, doc_id, text, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT source, doc_id, before + strlen(text) <= 20000 AS whole FROM s WHERE before < 20000")
def context_budget(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.lit("p").alias("path"), F.col("text").alias("content"), F.octet_length("text").alias("size"))
    out = post.context_budget(d, ["source"], ["doc_id"], 20000)
    return out.select("source", "doc_id", (F.octet_length("content") == F.col("size")).alias("whole"))


@query("first_hard_block", "SELECT CAST(user_id AS VARCHAR) AS repo_id, coalesce(min(event_id) FILTER (event_type = 'error'), min(event_id) FILTER (event_type = 'click')) AS seq FROM events WHERE event_type IN ('error','click') GROUP BY 1")
def first_hard_block(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").cast("string").alias("repo_id"), F.col("event_id").cast("string").alias("path"), F.lit("i").alias("issue"), F.lit("HARD_BLOCK").alias("severity"), F.col("event_id").alias("seq"), "event_type"
    )
    out = post.first_hard_block(rows.where(F.col("event_type") == "click"), rows.where(F.col("event_type") == "error"))
    return out.select("repo_id", F.col("path").cast("bigint").alias("seq"))


@query("file_findings", "SELECT event_id FROM events WHERE user_id = 7")
def file_findings(spark, sf):
    rows = events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/w/"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("path"))
    return post.findings_for_file(rows, "7", "/w").select("event_id")


@query("alert_rows", "SELECT event_id, '/w/f' || user_id AS path, CASE WHEN event_type = 'error' THEN CAST(user_id + 1 AS INTEGER) ELSE 5 END AS line, CASE WHEN event_type = 'error' THEN 'SQL_INJECTION' ELSE 'fast-check' END AS issue_type, CASE WHEN event_type = 'error' THEN 'fuzzer' ELSE 'release-gate' END AS source FROM events WHERE event_type IN ('error','click')")
def alert_rows(spark, sf):
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    rows = events(spark, sf).select(
        F.col("event_id").cast("string").alias("repo_id"), F.concat(F.lit("f"), u).alias("path"), F.lit(5).alias("line"), F.lit("i").alias("issue"), F.lit("fast-check").alias("source"),
        F.when(e.isin("error", "click"), "HARD_BLOCK").otherwise("WARNING").alias("severity"), F.when(e == "error", "p").alias("payload"), F.when(e == "error", "SQL_INJECTION").alias("vuln_type"),
        F.array(F.lit("x -> y"), F.concat(F.lit("f:"), (F.col("user_id") + 1).cast("string"), F.lit(" -> z"))).alias("trail"),
    )
    return score.to_alerts(rows, F.lit("/w/")).select(F.col("repo_id").cast("bigint").alias("event_id"), "path", "line", "issue_type", "source")
