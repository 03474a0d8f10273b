"""Text-to-table operators: lines, matches, tokens, nesting, scoped constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskspark.functions import lexer, text as tx
from riskspark.functions.regex import java
from riskspark.functions.text import find_all

def lines(table: DataFrame, text: str = "content", *keys: str) -> DataFrame:
    """1-based lines; a narrow generator, no shuffle."""
    keys = keys or ("repo_id", "path")
    return table.select(*keys, F.posexplode(F.split(text, tx.LINE_BREAK, -1)).alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).alias("line"), "text"
    )


def matches(table: DataFrame, pattern: str, text: str = "content", *keys: str) -> DataFrame:
    """All matches of one pattern: k, character offset, line, text."""
    keys = keys or ("repo_id", "path")
    p = java(pattern)
    return table.select(*keys, F.explode(find_all(F.col(text), p)).alias("m")).select(
        *keys, "m.k", F.col("m.start").alias("offset"), "m.line", F.col("m.text").alias("match")
    )


def tokens(files: DataFrame) -> DataFrame:
    """Token table (repo_id, path, pos, start, line, tok, kind, partner): comments and blanks are no tokens.

    ``partner`` is the place of the other bracket, or a literal's last place.  Strings, templates and regular expressions
    are one token each; code inside a template's ``${}`` follows the template as tokens of its own.
    """
    rest = find_all(F.col("lexed.bare"), r"[A-Za-z_$][\w$]*+|\d[\w.]*+|[^\s(){}\[\]]")
    none = F.lit(None).cast("int")
    plain = F.transform(
        rest,
        lambda m: F.struct(
            m["start"].alias("start"), m["line"].alias("line"), m["text"].alias("tok"),
            F.when(m["text"].rlike(r"\A[A-Za-z_$]"), "word").when(m["text"].rlike(r"\A\d"), "number").otherwise("punct").alias("kind"), none.alias("partner"),
        ),
    )
    known = F.transform(
        F.col("lexed.tokens"),
        lambda t: F.struct(
            t["start"].alias("start"), t["line"].alias("line"), t["text"].alias("tok"),
            F.when(F.length(t["kind"]) == 1, "punct").otherwise(t["kind"]).alias("kind"), t["partner"].alias("partner"),
        ),
    )
    lexed = files.select("repo_id", "path", lexer.facts(F.col("content"), lexer.TOKENS).alias("lexed"))
    return lexed.select("repo_id", "path", F.posexplode(F.array_sort(F.concat(plain, known))).alias("pos", "t")).select("repo_id", "path", "pos", "t.*")


def _file_order():
    return Window.partitionBy("repo_id", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def brace_depth(toks: DataFrame) -> DataFrame:
    """Block nesting per token; an opening brace counts itself, a closing one does not."""
    step = F.when((F.col("kind") == "punct") & (F.col("tok") == "{"), 1).when((F.col("kind") == "punct") & (F.col("tok") == "}"), -1).otherwise(0)
    return toks.withColumn("depth", F.sum(step).over(_file_order()))


def blocks(files: DataFrame) -> DataFrame:
    """Brace pairs as rows: (repo_id, path, depth, open_at, close_at, parent_open, parent_close), character offsets.

    The pair around an outermost one is the file: -1 and the text's length.
    """
    lexed = files.where(F.col("content").contains("{")).select(
        "repo_id", "path", F.explode(lexer.facts(F.col("content"), lexer.BLOCKS)["blocks"]).alias("b"))
    return lexed.select(
        "repo_id", "path", "b.depth", F.col("b.open").alias("open_at"), F.col("b.close").alias("close_at"), F.col("b.parent").alias("parent_open"),
        "b.parent_close")


def enclosing_block(hits: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Innermost block around each (repo_id, path, offset); NULLs mean the whole file.

    Blocks nest, so the innermost one changes only at a brace: to the pair it opens, or to the pair around the one it
    closes.  One window over a file's braces and hits carries it along; no hit meets more than the brace before it.
    """
    keys = ["repo_id", "path", "offset"]
    pair = lambda a, b: F.when(a >= 0, F.struct(a.alias("open_at"), b.alias("close_at")))
    edge = lambda at, now: F.struct(at.alias("offset"), F.lit(0).alias("hit"), F.struct(now.alias("now")).alias("edge"))
    c = F.col
    edges = block_rows.select("repo_id", "path", F.explode(F.array(
        edge(c("open_at"), pair(c("open_at"), c("close_at"))), edge(c("close_at") + 1, pair(c("parent_open"), c("parent_close"))))).alias("e"))
    flat = edges.select("repo_id", "path", "e.*")
    asked = hits.select(*keys).distinct().select(*keys, F.lit(1).alias("hit"), F.lit(None).cast(flat.schema["edge"].dataType).alias("edge"))
    # of two edges at one place the opening one counts: it has the larger block start
    order = Window.partitionBy("repo_id", "path").orderBy("offset", "hit", F.col("edge.now.open_at").asc_nulls_first())
    seen = flat.unionByName(asked).withColumn("edge", F.last("edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return hits.join(seen.where("hit = 1").select(*keys, "edge.now.open_at", "edge.now.close_at"), keys, "left")


# --- scoped constants -------------------------------------------------------------------------

def const_bindings(files: DataFrame) -> DataFrame:
    """Constants with static text and their scope.

    (repo_id, path, name, value, decl_at, decl_end, scope_open, scope_close, line); a file-level constant has scope [-1, file
    length].  Members of object and array literals are ``name.key``; unpacked names stand for themselves.
    """
    rows = files.where(F.col("content").contains("const")).select(
        "repo_id", "path", F.explode(lexer.facts(F.col("content"), lexer.CONSTS)["consts"]).alias("c"))
    return rows.where(F.col("c.value").isNotNull()).select(
        "repo_id", "path", "c.name", "c.value", F.col("c.start").alias("decl_at"), F.col("c.end").alias("decl_end"), "c.scope_open", "c.scope_close", "c.line")


def binding_lookup(reads: DataFrame, bindings: DataFrame, *keys: str) -> DataFrame:
    """Value each read sees: nearest enclosing scope, declared before the read.

    ``reads`` has (keys…, name, pos).  Equality on keys and name carries the
    join; scope nesting is its residual condition.  Reads with no binding keep
    NULL.
    """
    keys = list(keys or ("repo_id", "path"))
    on = keys + ["name"]
    seen = reads.join(bindings.select(*on, "value", "decl_end", "scope_open", "scope_close"), on).where(
        F.col("pos").between(F.col("scope_open"), F.col("scope_close")) & (F.col("decl_end") <= F.col("pos"))
    )
    # inner scopes win; the first declaration in one scope is the one that counts
    order = F.struct(F.col("scope_open"), -F.col("decl_end"), F.col("value"))
    best = seen.groupBy(*on, "pos").agg(F.max_by("value", order).alias("value"))
    return reads.join(best, on + ["pos"], "left")
