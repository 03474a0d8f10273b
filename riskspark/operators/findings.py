"""Building findings and running row-local rules in one pass over the text."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import schemas
from riskspark.functions import lexer, text as tx

TYPES = dict(schemas.FINDING_FIELDS)
NO_FINDINGS = f"cast(array() as array<{schemas.FINDING}>)"


class Source(NamedTuple):
    """The columns a rule may read: ``code`` has comments blanked, ``bare`` strings too; ``spans`` are the lexer's arrays
    that the rule asks for (``needs``)."""

    path: Column
    content: Column
    code: Column
    bare: Column
    spans: Column


Rule = Callable[[Source], "Guarded | Column"]  # -> array<finding>


def finding(**fields) -> Column:
    """One finding struct; unset fields are typed NULLs."""
    cols = []
    for name, typ in schemas.FINDING_FIELDS:
        value = fields.pop(name, None)
        if value is None:
            cols.append(F.expr(f"cast(null as {typ}) as {name}"))
            continue
        col = value if isinstance(value, Column) else F.lit(value)
        cols.append(col.cast(typ).alias(name))
    if fields:
        raise TypeError(f"unknown finding fields: {sorted(fields)}")
    return F.struct(*cols)


def text_fix(content: Column, start: Column, text: Column, **fields) -> Column:
    """Replace ``text`` found at character ``start``; offsets are bytes."""
    first = tx.byte_offset(content, start)
    values = {
        "kind": F.lit("credential"),
        "expected_text": text,
        "start_byte": first,
        "end_byte": first + F.octet_length(text),
        **fields,
    }
    names = ["kind", "credential_id", "replacement", "expected_text", "start_byte", "end_byte", "raw_snippet"]
    cols = [
        values.get(n, F.lit(None)).cast("int" if n.endswith("_byte") else "string").alias(n) for n in names
    ]
    return F.struct(*cols)


def none() -> Column:
    return F.expr(NO_FINDINGS)


class Guarded(NamedTuple):
    """Findings behind a cheap guard that reads path and content only; ``needs`` are the lexer's spans they read."""

    guard: Column
    findings: Column
    needs: int = 0

    def column(self) -> Column:
        return F.when(F.coalesce(self.guard, F.lit(False)), self.findings).otherwise(none())


def when(guard: Column, findings: Column, needs: int = 0) -> Guarded:
    return Guarded(guard, findings, needs)


def only(rule: Rule, keep: Callable[[Column], Column]) -> Rule:
    """The rule restricted to findings that satisfy ``keep``."""

    def restricted(f: Source):
        inner = rule(f)
        return Guarded(inner.guard, F.filter(inner.findings, keep), inner.needs) if isinstance(inner, Guarded) else F.filter(inner, keep)

    return restricted


def prepare(files: DataFrame, want: Column | int = 0) -> DataFrame:
    """Lex once for all rules: the masked texts and the wanted spans."""
    lexed = files.withColumn("lexed", lexer.facts(F.col("content"), want))
    return lexed.withColumn("code", F.col("lexed.code")).withColumn("bare", F.col("lexed.bare"))


def source() -> Source:
    """The columns of a prepared table."""
    return Source(F.col("path"), F.col("content"), F.col("code"), F.col("bare"), F.col("lexed"))


_COMPILED: dict = {}


def compiled(files: DataFrame, rule: Rule) -> Guarded | Column:
    """The rule's expression.  It only names columns, so one object serves every plan of a session."""
    key = (files.sparkSession.sparkContext.applicationId, rule)
    if key not in _COMPILED:
        _COMPILED[key] = rule(source())
    return _COMPILED[key]


def run_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """All row-local rules in one projection and one explode: no shuffle, text read once.

    Files on which no rule's guard holds are dropped before they are lexed.
    ``seq`` numbers findings in rule order within a file.
    """
    parts = [compiled(files, rule) for rule in rules]
    hits = [p.column() if isinstance(p, Guarded) else p for p in parts]
    merged = hits[0] if len(hits) == 1 else F.concat(*hits)
    live = F.col("content").isNotNull()
    if all(isinstance(p, Guarded) for p in parts):
        live = live & functools.reduce(lambda a, b: a | b, [F.coalesce(p.guard, F.lit(False)) for p in parts])
    asked = [F.when(F.coalesce(p.guard, F.lit(False)), p.needs).otherwise(0) for p in parts if isinstance(p, Guarded) and p.needs]
    base = prepare(files.where(live), functools.reduce(lambda a, b: a.bitwiseOR(b), asked) if asked else 0)
    out = base.select("repo_id", "path", F.posexplode(merged).alias("seq", "f"))
    return out.select("repo_id", "path", F.col("seq").cast("bigint").alias("seq"), "f.*")
