import random
import re

from pyspark.sql import functions as F

from riskspark.functions import lexer, paths as pf, scalars as sc, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import let


def test_positions_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["", "\n", "ab", "x" * 5, "é\nab\r\nab"] + ["".join(rng.choice("ab \né😀") for _ in range(n)) for n in (50, 700, 3000)]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    got = df.select("content", tx.find_all(F.col("content"), "ab").alias("m")).collect()
    for row in got:
        want = [(m.start(), row.content[: m.start()].count("\n") + 1) for m in re.finditer("ab", row.content)]
        assert [(m.start, m.line) for m in row.m] == want


def test_mask_keeps_length_and_lines(spark):
    src = "a // x {\nb = '}' + \"\\\"}\"; /* {\n{ */ `${x}\n{`\n// end"
    df = spark.createDataFrame([(src,)], "content string")
    code, bare = df.select(lexer.facts(F.col("content")).alias("l")).select("l.code", "l.bare").first()
    assert len(code) == len(bare) == len(src)
    assert code.count("\n") == bare.count("\n") == src.count("\n")
    assert "{" not in bare and "'}'" in code and "x {" not in code


def test_boundaries_follow_ascii_words(spark):
    df = spark.createDataFrame([("éexec(", True), ("xexec(", False), ("exec (", True), ("exec (", True)], "t string, want boolean")
    for row in df.select("t", "want", F.col("t").rlike(java(r"\bexec\s*\(")).alias("got")).collect():
        assert row.got == row.want, row.t


def test_end_anchor_is_the_end_of_input(spark):
    assert spark.createDataFrame([("abc\n",)], "t string").select(F.col("t").rlike(java("^abc$"))).first()[0] is False


def test_enclosing_block(spark):
    src = "a { b { c } d { e } f } g"
    df = spark.createDataFrame([(src,)], "content string")
    at = lambda ch: df.select(tx.block_text(F.col("content"), lexer.facts(F.col("content"), lexer.BLOCKS)["blocks"], F.lit(src.index(ch)))).first()[0]
    assert at("c") == "{ c }" and at("f") == "{ b { c } d { e } f }" and at("g") == src


def test_fixpoint_follows_chains_and_cycles(spark):
    df = spark.sql("select array('a') s, array(struct('c' name, 'b' src), struct('b' name, 'a' src), struct('a' name, 'c' src), struct('z' name, 'y' src)) e")
    got = df.select(tx.fixpoint(F.col("s"), F.col("e"), lambda e, n: F.array_contains(n, e["src"]))).first()[0]
    assert sorted(got) == ["a", "b", "c"]


def test_ignore_patterns(spark):
    cases = [("vendor/a.js", "vendor/", True), ("a/vendor/b.js", "vendor/", False), ("a/b.js", "*.js", True), ("a/lib/b.js", "lib", True),
             ("lib", "lib", True), ("a/lib", "lib", False), ("a+b.js", "a+*", True), ("x", "", False)]
    df = spark.createDataFrame(cases, "p string, x string, want boolean")
    for r in df.select("*", pf.matches_ignore(F.col("p"), F.col("x")).alias("got")).collect():
        assert r.got == r.want, (r.p, r.x)


def test_target_globs(spark):
    cases = [("src/a/b.ts", "src/**", True), ("src/a/b.ts", "src/*", False), ("src/b.ts", "src/*.ts", True), ("src/b.ts", "src", True), ("srcx/b.ts", "src", False)]
    df = spark.createDataFrame(cases, "p string, x string, want boolean")
    for r in df.select("*", pf.matches_target(F.col("p"), F.col("x")).alias("got")).collect():
        assert r.got == r.want, (r.p, r.x)


def test_truncate_never_breaks_decoding(spark):
    df = spark.createDataFrame([("ééé",)], "t string")
    assert df.select(sc.truncate_utf8(F.col("t"), F.lit(4), marker="|")).first()[0] == "éé|"


def test_statements_respect_quotes_and_comments(files):
    from riskspark.operators.sqlrls import sql_statements

    sql = "-- a;b\nselect ';' ; /* ; */ select $x$ ; $x$;\n select \";\"; tail"
    got = [r.sql.strip() for r in sql_statements(files({"a.sql": sql})).orderBy("stmt").collect()]
    assert got == ["-- a;b\nselect ';' ;", "/* ; */ select $x$ ; $x$;", 'select ";";', "tail"]


def test_plain_predicates_are_judged_as_any_other(spark):
    """Numbers and plain strings take a short way, which must agree with the general one."""
    sides = ["1", "1.0", "01", "12", "1234567890123", "'a'", "'ab'", "''", "'it''s'", "'a b'", '"a"', "TRUE", "x", "1."]
    forms = ["{}{}{}", "{} {} {}", " {}\n{}  {}\t"]
    texts = [f.format(a, o, b) for f in forms for a in sides for o in ("=", "<>", "!=", ">=", "<=", ">", "<", "=>", "=!") for b in sides]
    texts += [None, "", "1>", "1=1=1", "'a=b' = 'c'", "'a' = 'b=c'", "'a'\n='a'"]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select("p", sc.static_predicate(F.col("p")).alias("found"), let(sc.trim(F.col("p")), sc._any_predicate).alias("general"))
    assert df.where("not (found <=> general)").count() == 0
    some = {r.p: r.found for r in df.collect()}
    assert some["1=1"] == some["'a' = 'a'"] == "tautological RLS predicate" and some["1=1.0"] == some["'a'<'ab'"] == "statically true RLS predicate" and some["1>12"] is None
