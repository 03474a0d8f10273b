"""Column building blocks over text: positions, lines, masks, tokens.

Everything here is row-local: no shuffle, no Python worker.  Arrays that are
read more than once are bound with :func:`let`, because an expression that is
merely repeated inside a lambda would be evaluated once per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

LINE_BREAK = r"\r?\n"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
STRING = rf"(?:{_DOUBLE}|{_SINGLE})"
STRING_OR_TEMPLATE = rf"(?:{_TEMPLATE}|{_DOUBLE}|{_SINGLE})"
IDENT = r"[A-Za-z_$][\w$]*"
WORDS = r"[A-Za-z_$][\w$]*+"

# a line goes on after an operator, and before one at the start of the next line
MORE = r"(?:(?<=[=+*%&|?:,<>-][ \t]{0,8})\n|\n(?=\s*+(?:\??\.|[+*%&|?:,=<>-](?![+-]))))"

MATCH = "struct<k:int,start:int,line:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.left(content, offset), LINE_BREAK, -1))


def byte_offset(content: Column, offset: Column) -> Column:
    return F.octet_length(F.left(content, offset))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


_BLOCK = 128


def _blocks(values: Column) -> Column:
    """Sums of consecutive runs, so a prefix sum costs O(n/128 + 128)."""
    return F.transform(
        F.sequence(F.lit(0), (F.size(values) / _BLOCK).cast("int")),
        lambda b: _sum(F.slice(values, b * _BLOCK + 1, _BLOCK)),
    )


def _prefix(values: Column, blocks: Column, i: Column) -> Column:
    full = (i / _BLOCK).cast("int")
    return _sum(F.slice(blocks, F.lit(1), full)) + _sum(F.slice(values, full * _BLOCK + 1, i % _BLOCK))


def find_all(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a (Java) pattern: array<struct<k, start, line, text>>.

    ``start`` is a 0-based character offset.  ``keep`` filters on the match text
    before positions are worked out.
    """
    empty = F.expr(f"cast(array() as array<{MATCH}>)")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def positions(b: Column) -> Column:
        gaps = F.slice(b["p"], F.lit(1), F.size(b["m"]))
        steps = F.zip_with(gaps, b["m"], lambda g, m: F.length(g) + F.length(m))
        nls = F.zip_with(gaps, b["m"], lambda g, m: newlines(g) + newlines(m))
        arrays = F.struct(b["p"].alias("p"), b["m"].alias("m"), steps.alias("s"), nls.alias("n"))
        return let(arrays, with_sums)

    def with_sums(a: Column) -> Column:
        return let(
            F.struct(a.alias("a"), _blocks(a["s"]).alias("sb"), _blocks(a["n"]).alias("nb")), build
        )

    def build(z: Column) -> Column:
        a = z["a"]
        indexed = F.transform(a["m"], lambda m, i: F.struct(i.alias("i"), m.alias("m")))
        if keep is not None:
            indexed = F.filter(indexed, lambda x: keep(x["m"]))
        return F.transform(
            indexed,
            lambda x: F.struct(
                x["i"].alias("k"),
                (_prefix(a["s"], z["sb"], x["i"]) + F.length(F.get(a["p"], x["i"]))).cast("int").alias("start"),
                (1 + _prefix(a["n"], z["nb"], x["i"]) + newlines(F.get(a["p"], x["i"]))).cast("int").alias("line"),
                x["m"].alias("text"),
            ),
        )

    located = let(F.struct(pieces.alias("p"), hits.alias("m")), positions)
    return F.when(text.rlike(pattern), located).otherwise(empty)


def group(match_text: Column, pattern: str, index: int) -> Column:
    """Capture group of a pattern that is known to match ``match_text``."""
    return F.regexp_extract(match_text, pattern, index)


def enclosing_block_span(blocks: Column, offset: Column) -> Column:
    """struct<open, close> of the innermost of the lexer's ``blocks`` around ``offset`` (NULL if none)."""
    around = F.filter(blocks, lambda b: (b["open"] <= offset) & (b["close"] >= offset))
    return F.array_max(F.transform(around, lambda b: F.struct(b["open"].alias("open"), b["close"].alias("close"))))


def block_text(content: Column, blocks: Column, offset: Column) -> Column:
    """Text of the innermost block around ``offset``; the whole file if there is none."""
    return let(
        enclosing_block_span(blocks, offset),
        lambda s: F.when(s.isNull(), content).otherwise(F.substring(content, s["open"] + 1, s["close"] - s["open"] + 1)),
    )


def fixpoint(seeds: Column, edges: Column, uses: Callable[[Column, Column], Column]) -> Column:
    """Names reachable from ``seeds``: rounds of ``edges`` until nothing is added.

    ``edges`` is array<struct<name, ...>>; ``uses(edge, names)`` says whether an
    edge reads a known name.  Rounds after the last growth cost nothing.
    """

    def round_(acc: Column, _: Column) -> Column:
        fresh = F.array_except(
            F.transform(F.filter(edges, lambda e: uses(e, acc["names"])), lambda e: e["name"]), acc["names"]
        )
        grown = let(
            fresh,
            lambda f: F.struct(F.concat(acc["names"], f).alias("names"), (F.size(f) > 0).alias("more")),
        )
        return F.when(acc["more"], grown).otherwise(acc)

    start = F.struct(F.array_distinct(seeds).alias("names"), (F.size(seeds) > 0).alias("more"))
    rounds = F.sequence(F.lit(0), F.size(edges))
    return F.aggregate(rounds, start, round_)["names"]
