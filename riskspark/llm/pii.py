"""Personal data by weak supervision; DataFrame functions only.

Base spans are the matches of one pattern per kind that pass the kind's check (``BASE``).  They always stay.  The method
adds spans that the base patterns lose, say a phone number and a card number that stand next to each other:

1. candidates are the base matches, failed ones too, and the matches of ``WIDER`` patterns;
2. five labelers vote yes (1), no (-1) or nothing (0) on each candidate: its strict form, its check digits and ranges,
   gazetteers (issuers, calling codes, top-level domains, reserved address ranges), words before it, and what it touches;
3. votes are counted by kind and vote vector over all documents, at most 4 x 3^5 rows, and expectation maximisation on
   these counts estimates what each labeler says of true and of false spans, starting from the majority;
4. a logistic span classifier on kind and votes is trained on the posteriors and decides on the wider candidates; those
   that overlap a base span or an accepted candidate before them are left out.

Patterns are linear in the text: runs are possessive and entered at their start only.  Offsets are code points.

Cases: a null text is empty; rows are treated alone, so repeated rows and null ids get the same spans; without candidates
nothing is added; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.text import find_all
from riskspark.llm import common

KINDS = ["email", "ip", "card", "phone"]

# What counts as base spans, in Java's dialect.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]++)$",
    "card": r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$",
}
KNOWN = {
    "email": r"(?i)(?:\.| ?[\[(]dot[\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|in|br|ch|at)$",
    "ip": r"^(?!(?:0|10|127|22[4-9]|2[3-5][0-9])\.|192\.168\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\(|[2-9]|\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ .(-])",
}
FOR = r"(?i)(?:phone|tel|call|fax|mobile|cell|contact|mail|e-mail|card|visa|credit|payment|ip|address|host|server|reach)[^\n]{0,20}$"
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|page|chapter|section|figure|license|serial|sku|release|build)[^\n]{0,12}$"
BEFORE = 40
LABELERS = ["form", "check", "gazetteer", "context", "touch"]
VOTES = (-1, 0, 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _passes(kind: str, s: Column) -> Column:
    """The base check of a match."""
    n = F.length(_digits(s))
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", _digits(s)),
        "phone": n.between(8, 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, text: Column, start: Column, s: Column) -> list[Column]:
    n = F.length(_digits(s))
    check = {
        "email": _vote(s.rlike(r"[A-Za-z]{2,}$"), F.lit(True)),
        "ip": _vote(_passes("ip", s) & ~s.rlike(r"(?:^|\.)0[0-9]"), ~s.contains(":")),
        "card": _vote(n.between(16, 19) & F.call_function("luhn_check", _digits(s)), F.lit(True)),
        "phone": _vote(n.between(10, 13), ~n.between(8, 15)),
    }[kind]
    ahead = F.substring(text, F.greatest(F.lit(1), start + 1 - BEFORE), F.least(F.lit(BEFORE), start))
    around = F.concat(F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(" "), F.lit("|"), F.substring(text, start + F.length(s) + 1, F.lit(1)))
    known = s.rlike(KNOWN[kind])
    return [
        _vote(s.rlike(STRICT[kind]), F.lit(True)), check, _vote(known, ~known), _vote(ahead.rlike(FOR), ahead.rlike(AGAINST)),
        _vote(around.rlike(r"^[\s(\[<,;:\"']\|(?:$|[\s)\]>,;:.!?\"'])"), around.rlike(r"^[0-9A-Za-z_]\||\|[0-9A-Za-z_]")),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array<struct<kind, start, stop, base, wide, votes>>) for every row; ``base`` says that a base span stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.expr("cast(array() as array<struct<kind: int, start: int, stop: int, base: boolean, wide: boolean, votes: array<int>>>)")
    def spans(k: int, pattern: str, wide: bool) -> Column:
        kind = KINDS[k]
        return F.transform(find_all(F.col("text"), pattern), lambda x: F.struct(
            F.lit(k).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).cast("int").alias("stop"),
            (F.lit(False) if wide else _passes(kind, x["text"])).alias("base"), F.lit(wide).alias("wide"),
            F.array(*_votes(kind, F.col("text"), x["start"], x["text"])).alias("votes")))

    parts = [spans(k, patterns[kind], wide) for k, kind in enumerate(KINDS) for patterns, wide in ((BASE, False), (WIDER, True))]
    return rows.select("doc_id", F.when(F.col("text").rlike("[0-9@]|[\\[(]at"), F.concat(*parts)).otherwise(none).alias("found"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50):
    """Dawid-Skene expectation maximisation on (kind, votes, n): prior, P(vote | class) per labeler, posteriors."""
    share = lambda v: (1 + sum(1 for x in v if x > 0)) / (2 + sum(1 for x in v if x))  # noqa: E731  majority to start with
    post = [share(v) for _, v, _ in counts]
    prior, says = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, _, n in counts)
        prior = (1 + sum(p * n for p, (_, _, n) in zip(post, counts))) / (2 + total)
        says = []
        for j in range(len(LABELERS)):
            table = {(y, v): 1.0 for y in (0, 1) for v in VOTES}
            for p, (_, votes, n) in zip(post, counts):
                table[1, votes[j]] += p * n
                table[0, votes[j]] += (1 - p) * n
            says.append({(y, v): table[y, v] / sum(table[y, u] for u in VOTES) for y in (0, 1) for v in VOTES})
        new = []
        for _, votes, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(s[1, v] / s[0, v]) for s, v in zip(says, votes))
            new.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        moved = max((abs(a - b) for a, b in zip(post, new)), default=0)
        post = new
        if moved < 1e-6:
            break
    return prior, says, post


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(v == u) for v in votes for u in (-1, 1)]]


def train(counts: list[tuple[int, tuple[int, ...], int]], post: list[float], steps: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, each row weighted by its count's logarithm."""
    rows = [(_features(k, v), p, math.log1p(n)) for (k, v, n), p in zip(counts, post)]
    weights = [0.0] * len(_features(0, (0,) * len(LABELERS)))
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        grad = [-ridge * w for w in weights]
        for x, p, n in rows:
            z = sum(w * v for w, v in zip(weights, x))
            miss = n * (p - 1 / (1 + math.exp(-max(-30, min(30, z))))) / total
            for i, v in enumerate(x):
                if v:
                    grad[i] += miss * v
        weights = [w + rate * g for w, g in zip(weights, grad)]
    return weights


def fit(found: DataFrame) -> list[float] | None:
    """The classifier's weights from all candidates; only the counts of vote vectors reach the driver."""
    x = F.explode("found").alias("x")
    counts = [(r.kind, tuple(r.votes), r.n) for r in found.select(x).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n")).collect()]
    counts.sort()
    if not counts:
        return None
    return train(counts, reliabilities(counts)[2])


def decide(found: DataFrame, weights: list[float] | None, limit: float = 0.5) -> DataFrame:
    """(doc_id, base, added): arrays of struct<kind, start, stop>, ordered."""
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), plain))
    rows = found.withColumn("base", base)
    if weights is None:
        return rows.select("doc_id", "base", F.slice("base", F.lit(1), F.lit(0)).alias("added"))

    def accepted(x: Column) -> Column:
        z = F.lit(weights[0]) + F.get(F.array(*[F.lit(w) for w in weights[1:1 + len(KINDS)]]), x["kind"])
        for j in range(len(LABELERS)):
            no, yes = weights[1 + len(KINDS) + 2 * j:3 + len(KINDS) + 2 * j]
            z = z + F.when(x["votes"][j] == -1, no).when(x["votes"][j] == 1, yes).otherwise(0.0)
        return 1 / (1 + F.exp(-z)) >= limit

    apart = lambda x, y: (x["stop"] <= y["start"]) | (x["start"] >= y["stop"])
    rows = rows.withColumn("extra", F.array_sort(F.transform(
        F.filter("found", lambda x: x["wide"] & accepted(x) & F.forall("base", lambda y: apart(x, y))),
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))))
    added = F.transform(
        F.filter("extra", lambda x, i: ~F.exists(F.slice(F.col("extra"), F.lit(1), i), lambda y: ~apart(x, y))), plain)
    return rows.select("doc_id", "base", F.array_sort(added).alias("added"))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def number(spans: Column, kind: int) -> Column:
    """How many spans are of a kind; the function has one argument, as Spark gives a second one the element's place."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


@common.query("op5_pii")
def op5(spark, sf_dir):
    found = common.stored(candidates(common.table(spark, sf_dir, "documents")), "candidates")
    spans = decide(found, fit(found))
    every = F.array_sort(F.concat("base", "added"))
    counts = [number(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"), F.size("added").alias("n_added"))
