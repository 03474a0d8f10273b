"""ECMAScript pattern text to the Java dialect used by Spark's regex functions.

Differences that change results: ``\\b`` and ``\\s`` (Java 17 mixes Unicode and
ASCII rules for the first and leaves out NBSP and BOM in the second) and ``$``
(Java also matches before a final newline).
"""

_SPACE = r"\s ﻿  "
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _edges(pattern: str, at: int) -> str:
    """``\\b`` at ``at``: one lookaround where one side is known to be a word character."""
    after, before = pattern[at + 2 :], pattern[:at]
    if after[:1].isalnum() or _branches(after, first=True):
        return r"(?<!\w)"
    if (before[-1:].isalnum() and before[-2:-1] != "\\") or _branches(before, first=False):
        return r"(?!\w)"
    return _BOUNDARY


def _branches(text: str, first: bool) -> bool:
    """A plain group ``(?:a|b)`` beside the boundary whose branches all begin (or end) with a word character."""
    if first:
        if not text.startswith("(?:") or ")" not in text:
            return False
        body = text[3 : text.index(")")]
    else:
        if not text.endswith(")") or "(?:" not in text:
            return False
        body = text[text.rindex("(?:") + 3 : -1]
    if "(" in body or ")" in body:
        return False
    ends = [b[:1] if first else b[-1:] for b in body.split("|")]
    return all(e.isalnum() for e in ends) and (first or not any(b[-2:-1] == "\\" for b in body.split("|")))


def java(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == "\\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif pair == "\\b" and not in_class:
                out.append(_edges(pattern, i))
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        else:
            out.append(r"\z" if c == "$" else c)
        i += 1
    return "".join(out)


def any_of(patterns) -> str:
    """One alternation over several patterns, each keeping its own flags."""
    return "|".join(f"(?:{java(p)})" for p in patterns)
