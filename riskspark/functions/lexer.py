"""One linear pass over a source text: modes, bracket partners, masks, and the spans that rules read.

A lexer with a stack knows where it is: in code, in a template, or in code again inside a template's ``${}``.  Whether a
slash begins a regular expression follows from the token before it.  Every bracket gets its partner, so spans that end at
a closing bracket are found by one look-up at any depth.

:func:`facts` is the column form, one Arrow call per batch of files: masks and spans come back as columns, and all rules
stay column expressions over them.  Only the spans that the guards of the applied rules ask for are made.

* ``code``: the text with comments blanked; ``bare``: strings, template text and regular expressions blanked too, code
  inside ``${}`` kept.  Both keep length and line breaks.
* unmatched brackets have no partner and end nothing; an open string ends at its line's end, an open comment or template
  with the file.

A null text gives nulls.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import from_arrow_type

STRINGS, CALLS, FUNCTIONS, CHAINS, BLOCKS, CLIENTS, FOLDS, CONSTS, TOKENS, OPERANDS = (1 << k for k in range(10))

_CODE = re.compile(
    r"""(?P<plain>[^/'"`(){}\[\]]+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"""
    r"""|(?P<string>"[^"\\\n]*(?:\\(?:\r\n|[\s\S])[^"\\\n]*)*"?|'[^'\\\n]*(?:\\(?:\r\n|[\s\S])[^'\\\n]*)*'?)"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<tick>`)|(?P<slash>/)""")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_LAST_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z", re.A)
_OPENER = {")": "(", "]": "[", "}": "{"}
#: A value, so also a regular expression, may follow these.
_BEFORE_VALUE = frozenset("(,=:[!&|?;{+-*%~^")
_WORDS_BEFORE_VALUE = frozenset("return typeof case in of delete void instanceof new throw do else yield await from import".split())
_HEADS_BEFORE_VALUE = frozenset("if while for with".split())

_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$")
IDENT = r"[A-Za-z_$][\w$]*"


class Lexed:
    """Masks and bracket partners of one text.  ``ends`` maps the first place of a bracket, string, template or regular
    expression to its last one."""

    def __init__(self, text: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.literals: list[tuple[int, int]] = []  # strings, template text and regular expressions
        self.strings: list[tuple[int, int]] = []
        self.tokens: list[tuple[int, int, str]] = []  # brackets, strings, templates, regular expressions, in order
        self.ends: dict[int, int] = {}
        self.opener: dict[int, int] = {}  # last place -> first place, of brackets
        self.inserts: dict[int, int] = {}  # place of ${ -> place of its }
        self._run()
        self.code = self._masked(self.comments)
        self.bare = self._masked(sorted(self.comments + self.literals))
        self._breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_right(self._breaks, at - 1) + 1

    def _masked(self, spans: list[tuple[int, int]]) -> str:
        parts, at = [], 0
        for a, b in spans:
            parts.append(self.text[at:a])
            parts.append("\n".join([" " * len(line) for line in self.text[a:b].split("\n")]))
            at = b
        parts.append(self.text[at:])
        return "".join(parts)

    def _run(self) -> None:
        text, n, at = self.text, len(self.text), 0
        stack: list[tuple[str, int, bool]] = []  # mark, place, whether a value may follow its closing
        open_now = {"(": 0, "[": 0, "{": 0}  # since the innermost template
        outer: list[dict[str, int]] = []
        last, value_next = -1, False  # last visible place; a value may follow although it is a closing bracket
        while at < n:
            if stack and stack[-1][0] == "`":
                end = _TEMPLATE.match(text, at).end()
                begin = at
                if text.startswith("${", end):
                    at = end + 2
                    self.literals.append((begin, at))
                    stack.append(("$", end, False))
                    outer.append(open_now)
                    open_now = {"(": 0, "[": 0, "{": 0}
                    last, value_next = at - 1, False
                elif end < n and text[end] == "`":
                    at = end + 1
                    self.literals.append((begin, at))
                    self.ends[stack.pop()[1]] = end
                    last, value_next = end, False
                else:
                    self.literals.append((begin, n))
                    at = n
                continue
            m = _CODE.match(text, at)
            kind, begin, at = m.lastgroup, m.start(), m.end()
            if kind == "plain":
                visible = m[0].rstrip()
                if visible:
                    last, value_next = begin + len(visible) - 1, False
            elif kind == "comment":
                self.comments.append((begin, at))
            elif kind == "string":
                if begin and text[begin - 1] in _WORD and self._word(begin - 1) not in _WORDS_BEFORE_VALUE:
                    at, last, value_next = begin + 1, begin, False  # an apostrophe within a word
                    continue
                self.strings.append((begin, at))
                self.literals.append((begin, at))
                self.tokens.append((begin, at, "string"))
                self.ends[begin] = last = at - 1
                value_next = False
            elif kind == "tick":
                self.literals.append((begin, at))
                self.tokens.append((begin, at, "template"))
                stack.append(("`", begin, False))
            elif kind == "open":
                head = m[0] == "(" and last >= 0 and self._word(last) in _HEADS_BEFORE_VALUE
                stack.append((m[0], begin, head))
                open_now[m[0]] += 1
                self.tokens.append((begin, at, m[0]))
                last, value_next = begin, False
            elif kind == "close":
                if m[0] == "}" and not open_now["{"] and outer:
                    while stack[-1][0] != "$":
                        stack.pop()  # brackets left open in it
                    self.inserts[stack.pop()[1]] = begin
                    open_now = outer.pop()
                    self.literals.append((begin, at))
                    continue
                want, value_next = _OPENER[m[0]], False
                if open_now[want]:
                    while True:
                        mark, place, head = stack.pop()
                        open_now[mark] -= 1
                        if mark == want:
                            break
                    self.ends[place], self.opener[begin] = begin, place
                    value_next = head
                self.tokens.append((begin, at, m[0]))
                last = begin
            else:
                found = _REGEX.match(text, begin) if value_next or self._value_may_follow(last, begin) else None
                if found:
                    at = found.end()
                    self.literals.append((begin, at))
                    self.tokens.append((begin, at, "regex"))
                    self.ends[begin] = at - 1
                last, value_next = at - 1, False

    def _word(self, at: int) -> str:
        """The word that ends at a place, if it is short."""
        found = _LAST_WORD.search(self.text, max(0, at - 11), at + 1)
        return found[0] if found and (found.start() == 0 or self.text[found.start() - 1] != ".") else ""

    def _value_may_follow(self, last: int, at: int) -> bool:
        """Whether a slash at ``at`` can begin a regular expression, ``last`` being the visible place before it."""
        if self.text.startswith("/>", at):
            return False
        if last < 0:
            return True
        c = self.text[last]
        if c in _WORD:
            return self._word(last) in _WORDS_BEFORE_VALUE
        if c == ">":
            return last > 0 and self.text[last - 1] == "="
        if c == "}":
            return "\n" in self.text[last:at]
        if c in "+-":
            return last == 0 or self.text[last - 1] != c
        return c in _BEFORE_VALUE


# --- spans -----------------------------------------------------------------------------

_STOP = re.compile(r"[;\n(){}\[\]'\"`/]")
_GOES_ON_AFTER = re.compile(r"[=+*%&|?:,<>-][ \t]*\Z")
_GOES_ON_BEFORE = re.compile(r"\s*(?:\??\.|[+*%&|?:,=<>-](?![+-]))")
_NOT_CALLS = frozenset("if for while switch catch function return typeof await else do import super".split())
_DECLARED = re.compile(r"(?<![\w$.])(const|let|var)\s+", re.A)
_NAME = re.compile(IDENT, re.A)
_EQUALS = re.compile(r"\s*(?::[^=;\n]*)?=(?![=>])")
_ASSIGNED = re.compile(rf"(?<=[\n;{{}}])[ \t]*({IDENT}(?:\s*\.\s*{IDENT})*)\s*=(?![=>])", re.A)
_FUNCTION = re.compile(
    rf"(?<![\w$.])(?:(?:async\s+)?function\s+({IDENT})\s*(?=\()|(?:const|let|var)\s+({IDENT})\s*(?::[^=;\n]*)?=\s*(?:async\s*)?(?:(?=\()|(function\b)|{IDENT}))", re.A)
_ARROW = re.compile(r"\s*(?::[^=;{\n]*)?=>")
_SPACES = re.compile(r"\s*")
_PLUS = re.compile(r"\s*\+(?!\+)\s*")
_OPERAND_START = re.compile(r"(?<![\w$.])(?=[\w$(\[])|(?=['\"`])", re.A)
_MEMBER = re.compile(rf"\s*\??\.\s*{IDENT}", re.A)
_NUMBER = re.compile(r"\d[\w.]*", re.A)
_SQL_WORD = re.compile(r"(?i)\b(?:select|insert|update|delete)\b")


class Scopes:
    """Innermost block around any place, and the blocks around a block."""

    def __init__(self, blocks: list[tuple[int, int]], size: int):
        self.close = dict(blocks) | {-1: size}
        self.parent: dict[int, int] = {}
        self.points, self.inner = [0], [-1]
        held = [-1]
        for at, opens in sorted([(a, True) for a, _ in blocks] + [(b + 1, False) for _, b in blocks], key=lambda e: (e[0], e[1])):
            if opens:
                self.parent[at] = held[-1]
                held.append(at)
            else:
                held.pop()
            self.points.append(at)
            self.inner.append(held[-1])

    def of(self, at: int) -> int:
        """Opening place of the innermost block; -1 is the file."""
        return self.inner[bisect_right(self.points, at) - 1]

    def around(self, at: int):
        """All blocks around a place, innermost first, the file last."""
        scope = self.of(at)
        while scope != -1:
            yield scope
            scope = self.parent[scope]
        yield -1


class Static:
    """Values of constant expressions.  A name means the innermost block that declares it before the read; one whose
    value is not constant hides outer ones.  Parameters and other variables declare nothing here."""

    def __init__(self, spans: Spans):
        self.spans, self.rows, self.known = spans, [], {}
        self.limit = max(65536, len(spans.text))  # sums of sums could double without end

    def declare(self, name: str, a: int, b: int, begin: int, end: int) -> None:
        scope = self.spans.scopes.of(begin)
        value = self.value(a, b, begin)
        if (scope, name) not in self.known:  # the first one in a block counts
            self.known[scope, name] = (end, value)
            self.rows.append({
                "name": name, "expr": self.spans.code[a:b].strip(), "value": value, "start": begin, "end": end, "scope_open": scope,
                "scope_close": self.spans.scopes.close[scope], "line": self.spans.x.line(begin)})

    def of(self, name: str, at: int) -> str | None:
        for scope in self.spans.scopes.around(at):
            found = self.known.get((scope, name))
            if found and found[0] <= at:
                return found[1]
        return None

    def value(self, a: int, b: int, at: int) -> str | None:
        """Static text of the expression a..b, whose names are read at ``at``."""
        s = self.spans
        while True:
            while a < b and s.code[a].isspace():
                a += 1
            while b > a and s.code[b - 1].isspace():
                b -= 1
            if a >= b or s.code[a] != "(" or s.x.ends.get(a) != b - 1:
                break
            a, b = a + 1, b - 1
        text, count, end = self.prefix(a, at, b)
        return text if count and end == b else None

    def prefix(self, a: int, at: int, stop: int | None = None) -> tuple[str, int, int]:
        """Static text of the first operands of a sum, their number and where they end."""
        s, out, size, behind = self.spans, [], 0, -1
        while True:
            end = s.operand_end(a)
            if end <= a or (stop is not None and end > stop):
                break
            try:
                part = self._operand(a, end, at)
            except RecursionError:
                part = None
            if part is None or size + len(part) > self.limit:
                break
            out.append(part)
            size, behind = size + len(part), end
            plus = _PLUS.match(s.code, end)
            if plus is None:
                break
            a = plus.end()
        return "".join(out), len(out), behind

    def _operand(self, a: int, b: int, at: int) -> str | None:
        s, c = self.spans, self.spans.text[a]
        if c in "'\"":
            return s.text[a + 1:b - 1] if b - a > 1 and s.text[b - 1] == c else s.text[a + 1:b]
        if c == "`":
            return self._template(a, b, at)
        if c == "(":
            return self.value(a + 1, b - 1, at)
        if c == "[":
            return self._join(a, b, at)
        text = s.code[a:b]
        if _NAME.fullmatch(text):
            return self.of(text, at)
        m = _DECODED.fullmatch(text)
        if m:
            raw = re.sub(r"=+\Z", "", (m[2] or m[4]).translate(_URL_SAFE))
            try:
                return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-8", "replace")
            except ValueError:
                return None
        m = _DOTTED.fullmatch(text)
        if m:
            return self.of(f"{m[1]}.{m[2]}", at)
        m = _KEYED.fullmatch(text)
        if m:
            return self.of(f"{m[1]}.{m[3]}", at)
        m = _COMPUTED.fullmatch(text)
        if m:
            key = m[2] if m[2].isdigit() else self.of(m[2], at)
            return None if key is None else self.of(f"{m[1]}.{key}", at)
        return None

    def _template(self, a: int, b: int, at: int) -> str | None:
        s, out, size = self.spans, [], 0
        k, end = a + 1, b - 1
        while k < end:
            m = _TEMPLATE.match(s.text, k, end)
            out.append(_ESCAPE.sub(r"\1", m[0]))
            k = m.end()
            if s.text.startswith("${", k):
                close = s.x.inserts.get(k, -1)
                if close < 0:
                    return None
                part = self.value(k + 2, close, at) if s.code[k + 2:close].strip() else ""
                if part is None:
                    return None
                out.append(part)
                k = close + 1
            elif k < end:
                return None
            size += len(out[-1])
            if size > self.limit:
                return None
        return "".join(out)

    def _join(self, a: int, b: int, at: int) -> str | None:
        s = self.spans
        close = s.x.ends[a]
        m = _JOIN.match(s.code, close + 1, b)
        if m is None or s.x.ends.get(m.end() - 1) != b - 1:
            return None
        given = s.code[m.end():b - 1].strip()
        mark = "," if not given else self.value(m.end(), b - 1, at)
        items = [self.value(p, q, at) for p, q in s.arguments(a, close) if s.code[p:q].strip()]
        return None if mark is None or None in items else mark.join(items)


class Spans:
    """What rules read, cut out of a lexed text."""

    def __init__(self, lexed: Lexed):
        self.x, self.text, self.code, self.bare = lexed, lexed.text, lexed.code, lexed.bare

    def expression_end(self, at: int) -> int:
        """Place behind an expression: at a semicolon, an unmatched bracket, or a line end where nothing goes on."""
        bare, ends, n = self.bare, self.x.ends, len(self.bare)
        while True:
            m = _STOP.search(self.text, at)
            if m is None:
                return n
            k = m.start()
            c = bare[k]
            if k in ends:
                at = ends[k] + 1
            elif c == "\n":
                if not (_GOES_ON_AFTER.search(bare, max(0, k - 9), k) or _GOES_ON_BEFORE.match(bare, k + 1)):
                    return k
                at = k + 1
            elif c in ";)]}([{":
                return k
            else:
                at = k + 1

    def first_argument_end(self, opened: int, closed: int) -> int:
        at = opened + 1
        while at < closed:
            m = _COMMA.search(self.text, at, closed)
            if m is None:
                return closed
            k = m.start()
            if k in self.x.ends:
                at = self.x.ends[k] + 1
            elif self.bare[k] == ",":
                return k
            else:
                at = k + 1
        return closed

    def arguments(self, opened: int, closed: int) -> list[tuple[int, int]]:
        """(start, end) of each argument, or element, between two brackets."""
        out, at = [], opened + 1
        while at < closed:
            end = self.first_argument_end(at - 1, closed)
            out.append((at, end))
            at = end + 1
        return out

    def callee_start(self, opened: int) -> int:
        """Where the name before an opening bracket begins; -1 if no plain name or member chain stands there."""
        bare, code, at = self.bare, self.code, opened
        while at and code[at - 1].isspace():
            at -= 1
        while True:
            if at and bare[at - 1] == "]":
                at = self.x.opener.get(at - 1, -1)
                if at <= 0:
                    return -1
                continue
            begin = at
            while begin and bare[begin - 1] in _WORD:
                begin -= 1
            while begin < at and bare[begin].isdigit():
                begin += 1
            if begin == at:
                return -1
            before = begin
            while before and code[before - 1].isspace():
                before -= 1
            if not before or bare[before - 1] != ".":
                return begin
            at = before - 1
            if at and bare[at - 1] == "?":
                at -= 1
            while at and code[at - 1].isspace():
                at -= 1

    def calls(self) -> list[dict]:
        out = []
        for at, _, kind in self.x.tokens:
            if kind != "(":
                continue
            begin = self.callee_start(at)
            if begin < 0:
                continue
            first = _NAME.match(self.bare, begin)
            if first is None or first[0] in _NOT_CALLS or _LAST_WORD_BEFORE.search(self.bare, max(0, begin - 12), begin):
                continue
            end = self.x.ends.get(at, at + 1)
            cut = self.first_argument_end(at, end)
            args = self.code[at + 1:end] if at in self.x.ends else ""
            out.append({
                "start": begin, "line": self.x.line(begin), "callee": "".join(self.bare[begin:at].split()), "args": args,
                "first": self.code[at + 1:cut].strip() if args else "", "text": self.bare[begin:at + 1] + args + ")"})
        return out

    def shape(self, begin: int, end: int) -> str:
        """Kind of an expression: name, member, call or other."""
        while begin < end and self.code[begin].isspace():
            begin += 1
        while end > begin and self.code[end - 1].isspace():
            end -= 1
        m = _NAME.match(self.bare, begin, end)
        if m is None:
            return "other"
        at, kind = m.end(), "name"
        while at < end:
            m = _MEMBER.match(self.bare, at, end)
            k = _SPACES.match(self.code, at, end).end()
            if m:
                at, kind = m.end(), "member"
            elif k < end and self.bare[k] in "([" and k in self.x.ends and self.x.ends[k] < end:
                at, kind = self.x.ends[k] + 1, "call" if self.bare[k] == "(" else "member"
            else:
                return "other"
        return kind

    def target_end(self, at: int) -> int:
        if at < len(self.bare) and self.bare[at] in "{[":
            return self.x.ends.get(at, -2) + 1
        m = _NAME.match(self.bare, at)
        return m.end() if m else -1

    def _value(self, names: list[str], begin: int, after: int, declared: bool) -> dict:
        end = self.expression_end(_SPACES.match(self.code, after).end())
        return {
            "names": names, "value": self.code[after:end].strip(), "declared": declared, "line": self.x.line(begin), "start": begin, "end": end,
            "shape": self.shape(after, end)}

    def declarations(self):
        """(keyword, start, target end, place behind =) of each initialised declaration."""
        for m in _DECLARED.finditer(self.bare):
            end = self.target_end(m.end())
            equals = _EQUALS.match(self.bare, end) if end > 0 else None
            if equals:
                yield m[1], m.start(), m.end(), end, equals.end()

    def assigns(self) -> list[dict]:
        found = [self._value(_NAME.findall(self.bare[a:b]), begin, after, True) for _, begin, a, b, after in self.declarations()]
        return found + [self._value(_NAME.findall(m[1]), m.start(), m.end(), False) for m in _ASSIGNED.finditer(self.bare)]

    def functions(self) -> list[dict]:
        out = []
        for m in _FUNCTION.finditer(self.bare):
            at = m.end()
            if at < len(self.bare) and self.bare[at] == "(" and m[3] is None:
                if at not in self.x.ends:
                    continue
                at = self.x.ends[at] + 1
            if m[2] is not None and m[3] is None:
                arrow = _ARROW.match(self.bare, at)
                if arrow is None:
                    continue
                at = arrow.end()
            body = self.expression_end(at)
            brace = self._next_brace(at, body)
            end = self.x.ends[brace] + 1 if brace >= 0 else body
            out.append({"start": m.start(), "line": self.x.line(m.start()), "end": end, "name": m[1] or m[2]})
        return out

    def _next_brace(self, at: int, end: int) -> int:
        """First block between two places that is in no other bracket."""
        while at < end:
            m = _STOP.search(self.text, at, end)
            if m is None:
                return -1
            k = m.start()
            if self.bare[k] == "{" and k in self.x.ends:
                return k
            at = self.x.ends[k] + 1 if k in self.x.ends else k + 1
        return -1

    def operand_end(self, at: int) -> int:
        """Place behind a string, template, number, bracketed run, or member chain with calls; -1 if none begins here."""
        c = self.text[at] if at < len(self.text) else ""
        if c and c in "'\"`(":
            return self.x.ends.get(at, -2) + 1
        if c == "[":
            return self._members_end(self.x.ends.get(at, -2) + 1)
        m = _NUMBER.match(self.bare, at)
        if m:
            return m.end()
        m = _NAME.match(self.bare, at)
        if m is None:
            return -1
        return self._members_end(m.end())

    def _members_end(self, end: int) -> int:
        while end > 0:
            m = _MEMBER.match(self.bare, end)
            if m:
                end = m.end()
                continue
            if end < len(self.bare) and self.bare[end] in "([" and end in self.x.ends:
                end = self.x.ends[end] + 1
                continue
            break
        return end

    def chains(self) -> list[dict]:
        """``a + b + …`` with a string or template among the operands that holds a statement's word."""
        out, at = [], 0
        for m in _OPERAND_START.finditer(self.text):
            if m.start() < at or (self.bare[m.start()].isspace() and m.start() not in self.x.ends):
                continue
            parts = self.sum(m.start())
            if len(parts) < 2:
                # the inside of a string is no operand
                at = parts[0][1] if parts and self.text[m.start()] in "'\"" else at
                continue
            start, at = parts[0][0], parts[-1][1]
            if any(self.text[a] in "'\"`" and _SQL_WORD.search(self.text, a, b) for a, b in parts):
                out.append({
                    "start": start, "line": self.x.line(start), "text": self.code[start:at],
                    "parts": [{"at": a - start, "end": b - start} for a, b in parts]})
        return out

    def blocks(self) -> list[dict]:
        """Brace pairs by opening place, with their depth and the pair around them (-1 and the text's length: the file)."""
        out, held = [], []
        for at, close in sorted((a, b) for a, b in self.x.ends.items() if self.bare[a] == "{"):
            while held and held[-1][1] < at:
                held.pop()
            around = held[-1] if held else (-1, len(self.text))
            held.append((at, close))
            out.append({"open": at, "close": close, "depth": len(held), "parent": around[0], "parent_close": around[1]})
        return out

    def operands(self) -> list[str]:
        """Operands of the sum that the text is."""
        return [self.code[a:b] for a, b in self.sum(_SPACES.match(self.code).end())]

    def clients(self) -> list[dict]:
        """createClient(…) calls and their arguments."""
        out = []
        for m in _CLIENT.finditer(self.bare):
            at = m.end() - 1
            if at in self.x.ends:
                end = self.x.ends[at]
                given = self.arguments(at, end)
                out.append({
                    "start": m.start(), "end": end + 1, "first_end": given[0][1] if given else end, "line": self.x.line(m.start()),
                    "args": [self._argument(a, b, m.start()) for a, b in given]})
        return out

    def _argument(self, a: int, b: int, at: int) -> dict:
        """Source text, line, static texts in it (its own, its strings, what its names hold) and the names it reads."""
        while a < b and self.code[a].isspace():
            a += 1
        quoted = [self.text[p:q].strip("'\"`") for p, q, kind in self._literals(a, b)]
        reads = ["".join(r.split()) for r in _READ.findall(self.bare[a:b])]
        keyed = [f"{m[1]}.{m[3]}" for m in _KEYED.finditer(self.code, a, b)]
        bound = [self.static.of(name, at) for name in reads + keyed]
        values = [v for v in [self.static.value(a, b, at), *quoted, *bound] if v is not None]
        return {"text": self.code[a:b], "line": self.x.line(a), "values": values, "reads": reads}

    def _literals(self, a: int, b: int) -> list[tuple[int, int, str]]:
        k = bisect_left(self.x.tokens, (a, -1, ""))
        out = []
        while k < len(self.x.tokens) and self.x.tokens[k][0] < b:
            p, _, kind = self.x.tokens[k]
            if kind in ("string", "template") and p in self.x.ends:
                out.append((p, self.x.ends[p] + 1, kind))
            k += 1
        return out

    @functools.cached_property
    def scopes(self) -> Scopes:
        return Scopes([(s["open"], s["close"]) for s in self.blocks()], len(self.text))

    @functools.cached_property
    def static(self) -> Static:
        """Constants in source order, so what one reads is known before it is."""
        known = Static(self)
        for keyword, begin, a, b, after in self.declarations():
            if keyword == "const":
                at = _SPACES.match(self.code, after).end()
                end = self.expression_end(at)
                for name, p, q in self._bound(a, b, at, end):
                    known.declare(name, p, q, begin, end)
        return known

    def consts(self) -> list[dict]:
        """Constants with the block that declares them: plain ones, object members as ``name.key``, unpacked names.

        ``expr`` is the source text of the value, ``value`` its static text, if it has one.
        """
        return self.static.rows

    def _bound(self, a: int, b: int, at: int, end: int):
        """(name, start, end) of what a declaration with target a..b and value at..end binds."""
        while end > at and self.code[end - 1].isspace():
            end -= 1
        whole = self.x.ends.get(at, -1) == end - 1
        left, right = self.bare[a], self.bare[at] if at < len(self.bare) else ""
        if left not in "{[":
            yield self.bare[a:b], at, end
            if whole and right == "{":
                for key, p, q in self._members(at):
                    yield f"{self.bare[a:b]}.{key}", p, q
            elif whole and right == "[":
                for k, (p, q) in enumerate(self.arguments(at, end - 1)):
                    yield f"{self.bare[a:b]}.{k}", p, q
            return
        slots = [self.code[p:q].split("=", 1)[0].strip() for p, q in self.arguments(a, b - 1)]
        members, items = {}, []
        if whole and left == right == "{":
            members = {key: (p, q) for key, p, q in reversed(list(self._members(at)))}
        elif whole and left == right == "[":
            items = self.arguments(at, end - 1)
        for k, slot in enumerate(slots):
            key, _, local = slot.partition(":") if left == "{" else (slot, "", slot)
            local, key = (local or key).strip(), key.strip(" \t\r\n'\"")
            if _NAME.fullmatch(local):
                yield local, *(members.get(key, (end, end)) if left == "{" else items[k] if k < len(items) else (end, end))

    def _members(self, opened: int):
        """(key, start, end) of the ``key: value`` pairs of an object literal."""
        for a, b in self.arguments(opened, self.x.ends[opened]):
            m = _KEY.match(self.code, a, b)
            if m:
                yield m[1].strip("'\""), m.end(), b

    def folds(self) -> list[dict]:
        """Static text of sums, templates, joined arrays and decoded literals; a part of a found one is not given again."""
        out, at, later = [], 0, {}
        for m in _OPERAND_START.finditer(self.text):
            begin = m.start()
            if begin < at or (self.bare[begin].isspace() and begin not in self.x.ends):
                continue
            if begin in later:  # within a sum, whose beginning alone is a sum of its own
                parts = [(begin, later.pop(begin))]
            else:
                parts = self.sum(begin)
                later.update(parts[1:])
            if not parts:
                continue
            if self.text[begin] in "'\"":
                at = parts[0][1]  # the inside of a string is no operand
            if len(parts) > 1 or self.text[begin] in "`[" or self.shape(*parts[0]) == "call":
                value, count, behind = self.static.prefix(begin, begin, parts[-1][1])
                if value and (count == len(parts) or count > 1):
                    out.append({"start": begin, "line": self.x.line(begin), "value": value})
                    at = behind
        return out

    def sum(self, begin: int) -> list[tuple[int, int]]:
        """(start, end) of the operands of ``a + b + …``."""
        out = []
        while True:
            end = self.operand_end(begin)
            if end <= begin:
                return out
            out.append((begin, end))
            plus = _PLUS.match(self.code, end)
            if plus is None:
                return out
            begin = plus.end()

    def strings(self) -> list[dict]:
        return [{"start": a, "line": self.x.line(a), "text": self.text[a:b]} for a, b in self.x.strings]

    def tokens(self) -> list[dict]:
        """Brackets, strings, templates and regular expressions with their partner (last place; first of a closing one)."""
        return [
            {"start": a, "kind": kind, "partner": self.x.ends.get(a, self.x.opener.get(a)), "line": self.x.line(a),
             "text": self.text[a:self.x.ends.get(a, b - 1) + 1] if len(kind) > 1 else kind}
            for a, b, kind in self.x.tokens]


_READ = re.compile(rf"(?<![\w$.])({IDENT}(?:\s*\.\s*{IDENT})?)", re.A)
_KEYED = re.compile(rf"(?<![\w$.])({IDENT})\s*\[\s*(['\"`])([^'\"`\n]*)\2\s*\]", re.A)
_DOTTED = re.compile(rf"({IDENT})\s*\.\s*({IDENT})", re.A)
_COMPUTED = re.compile(rf"({IDENT})\s*\[\s*({IDENT}|\d+)\s*\]", re.A)
_JOIN = re.compile(r"\s*\.\s*join\s*\(")
_ESCAPE = re.compile(r"\\([\s\S])")
_B64 = r"([\"'`])([A-Za-z0-9+/=_-]+)"
_DECODED = re.compile(
    rf"atob\s*\(\s*{_B64}\1\s*\)|Buffer\s*\.\s*from\s*\(\s*([\"'`])([A-Za-z0-9+/=_-]+)\3\s*,\s*([\"'`])base64(?:url)?\5\s*\)"
    r"\s*\.\s*toString\s*\(\s*(?:([\"'`])(?:utf-?8|ascii|latin1)\6\s*)?\)")
_URL_SAFE = str.maketrans("-_", "+/")
_COMMA = re.compile(r"[,(){}\[\]'\"`/]")
_LAST_WORD_BEFORE = re.compile(r"(?:function|new)\s\Z")
_CLIENT = re.compile(r"(?<![\w$])createClient\s*\(", re.A)
_KEY = re.compile(rf"""\s*({IDENT}|'[^'\n]*'|"[^"\n]*")\s*:\s*""", re.A)

_I, _S = pa.int32(), pa.string()


def _rows(**fields) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


PARTS = {
    "strings": (STRINGS, _rows(start=_I, line=_I, text=_S)),
    "calls": (CALLS, _rows(start=_I, line=_I, callee=_S, args=_S, first=_S, text=_S)),
    "assigns": (CALLS, _rows(names=pa.list_(_S), value=_S, declared=pa.bool_(), line=_I, start=_I, end=_I, shape=_S)),
    "functions": (FUNCTIONS, _rows(start=_I, line=_I, end=_I, name=_S)),
    "chains": (CHAINS, _rows(start=_I, line=_I, text=_S, parts=_rows(at=_I, end=_I))),
    "blocks": (BLOCKS, _rows(open=_I, close=_I, depth=_I, parent=_I, parent_close=_I)),
    "clients": (CLIENTS, _rows(start=_I, end=_I, first_end=_I, line=_I, args=_rows(text=_S, line=_I, values=pa.list_(_S), reads=pa.list_(_S)))),
    "folds": (FOLDS, _rows(start=_I, line=_I, value=_S)),
    "consts": (CONSTS, _rows(name=_S, expr=_S, value=_S, start=_I, end=_I, scope_open=_I, scope_close=_I, line=_I)),
    "tokens": (TOKENS, _rows(start=_I, kind=_S, partner=_I, line=_I, text=_S)),
    "operands": (OPERANDS, pa.list_(_S)),
}
TYPE = pa.struct([("code", _S), ("bare", _S), *((name, kind) for name, (_, kind) in PARTS.items())])


def one(text: str | None, want: int) -> dict | None:
    if text is None:
        return None
    lexed = Lexed(text)
    spans = Spans(lexed)
    return {"code": lexed.code, "bare": lexed.bare} | {name: getattr(spans, name)() for name, (bit, _) in PARTS.items() if want & bit}


CHARS = 200_000


@F.arrow_udf(from_arrow_type(TYPE))
def _facts(text: pa.Array, want: pa.Array) -> pa.Array:
    """Spans are Python objects until they are Arrow's, so a batch goes through a few texts at a time."""
    parts, held, chars = [], [], 0
    for t, w in zip(text, want):
        found = one(t.as_py(), w.as_py() or 0)
        held.append(found)
        chars += len(found["code"]) if found else 1
        if chars >= CHARS:
            parts.append(pa.array(held, TYPE))
            held, chars = [], 0
    return pa.concat_arrays([*parts, pa.array(held, TYPE)])


def facts(content: Column, want: Column | int = 0) -> Column:
    """struct<code, bare, and the wanted spans> of a text column; spans nobody asked for are null."""
    return _facts(content, want if isinstance(want, Column) else F.lit(want))
