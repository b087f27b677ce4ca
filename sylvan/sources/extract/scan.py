"""Tokens of languages with braces, their bracket pairs, and what is measured on them."""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

from .rows import Rows

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, frozenset(")]}")


@dataclass
class Syntax:
    """What the scanner needs to know: one pattern with the groups comment, str, num, id, op and space, and the reserved words."""

    pattern: re.Pattern[str]
    keywords: frozenset[str]
    nested_comments: bool = False
    templates: bool = False
    regexes: bool = False


@dataclass
class Function:
    """A function found: its tokens, first to last, and what its row says."""

    name: str
    first: int
    last: int
    params: int
    returns: str
    visibility: str
    skip: set[int] = field(default_factory=set)


def covered(n: int, spans: Iterable[tuple[int, int]]) -> list[bool]:
    """For each of n tokens whether it lies in one of the spans, first to last; in one pass, however many spans there are."""
    change = [0] * (n + 1)
    for a, b in spans:
        if a <= b:
            change[max(0, a)] += 1
            change[min(n, b + 1)] -= 1
    return [depth > 0 for depth in accumulate(change[:n])]


class Code:
    """Tokens of a text. ``kind`` is id, num, str or op; keywords are ids that ``word`` tells apart."""

    def __init__(self, text: str, syntax: Syntax):
        self.text, self.syntax = text, syntax
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.comments: list[tuple[int, str]] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self._scan(0, len(text), "")
        self.n = len(self.tok)
        #: Text of every token that is a name or keyword, '' for the others.
        self.names = [t if k == "id" else "" for k, t in zip(self.kind, self.tok, strict=True)]
        #: Innermost bracket around every token, and innermost brace, or -1; a bracket is not around itself or its partner.
        self.around: list[int] = []
        self.brace: list[int] = []
        self.partner = self._pairs()
        self.dead = [False] * len(self.tok)

    def line(self, pos: int) -> int:
        return bisect_right(self.breaks, pos - 1) + 1 if pos else 1

    def at(self, i: int) -> str:
        return self.tok[i] if 0 <= i < self.n else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "id" and self.tok[i] not in self.syntax.keywords

    def word(self, i: int, *words: str) -> bool:
        return 0 <= i < self.n and self.names[i] in words

    def source(self, i: int, j: int) -> str:
        """Text of the tokens i to j."""
        return self.text[self.start[i] : self.end[j]] if 0 <= i <= j < len(self.tok) else ""

    def new_line(self, i: int) -> bool:
        """Whether a line ends before token i."""
        return i <= 0 or i >= len(self.tok) or "\n" in self.text[self.end[i - 1] : self.start[i]]

    def _put(self, kind: str, tok: str, a: int, b: int) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.start.append(a)
        self.end.append(b)

    def _scan(self, pos: int, end: int, until: str) -> int:
        depth, match, text = 0, self.syntax.pattern.match, self.text
        kinds, toks, starts, ends = self.kind.append, self.tok.append, self.start.append, self.end.append
        while pos < end:
            m = match(text, pos, end)
            if m is None:
                pos += 1
                continue
            group, stop = m.lastgroup, m.end()
            if group == "comment":
                if self.syntax.nested_comments and text.startswith("/*", pos):
                    stop = self._block_comment(pos)
                self.comments.append((pos, text[pos:stop]))
            elif group == "tick":
                stop = self._template(pos, end)
            elif group != "space" and group is not None:
                tok = m[0]
                if tok == "/" and self.syntax.regexes and (slash := self._regex(pos)) > pos:
                    group, stop, tok = "str", slash, text[pos:slash]
                elif until and group == "op":
                    depth += (tok == "{") - (tok == "}")
                    if depth < 0:
                        return pos
                kinds(group)
                toks(tok)
                starts(pos)
                ends(stop)
            pos = stop
        return end

    def _block_comment(self, pos: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.text, pos):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def _template(self, pos: int, end: int) -> int:
        """A template text: one str token, then the code of its substitutions, each in a pair of its own."""
        i = pos + 1
        self._put("str", "`", pos, pos + 1)
        own = len(self.tok) - 1
        while i < end:
            c = self.text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                self.end[own] = i + 1
                return i + 1
            elif self.text.startswith("${", i):
                self._put("op", "${", i, i + 2)
                i = self._scan(i + 2, end, "}")
                self._put("op", "}", i, min(end, i + 1))
                i += 1
            else:
                i += 1
        self.end[own] = end
        return end

    def _regex(self, pos: int) -> int:
        """End of a regular expression that starts here, or ``pos``: after a value a slash divides."""
        if self.tok and (self.kind[-1] in ("num", "str") or self.tok[-1] in (")", "]", "}") or (self.kind[-1] == "id" and self.tok[-1] not in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new"))):
            return pos
        m = re.compile(r"/(?![*/\s])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(self.text, pos)
        return m.end() if m else pos

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, (k, t) in enumerate(zip(self.kind, self.tok, strict=True)):
            if k == "op" and t in _CLOSE:
                for n in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if _OPEN[self.tok[stack[n]]] == t:
                        out[stack[n]], out[i] = i, stack[n]
                        del stack[n:]
                        break
            top = stack[-1] if stack else -1
            self.around.append(top)
            self.brace.append(top if top < 0 or self.tok[top] == "{" else self.brace[top])
            if k == "op" and t in _OPEN:
                stack.append(i)
        last = len(self.tok) - 1
        for i in stack:
            out[i] = last
        return out

    def close(self, i: int) -> int:
        """Partner of the bracket at i, or the last token."""
        return self.partner.get(i, len(self.tok) - 1)

    def find(self, i: int, end: int, *wanted: str) -> int:
        """First token of ``wanted`` from i to end outside brackets that open on the way, or -1."""
        while i <= end:
            if self.kind[i] in ("op", "id") and self.tok[i] in wanted:
                return i
            if self.kind[i] == "op" and self.tok[i] in _OPEN:
                i = self.close(i)
            elif self.kind[i] == "op" and self.tok[i] in _CLOSE:
                return -1
            i += 1
        return -1

    def split(self, i: int, end: int, sep: str = ",") -> list[tuple[int, int]]:
        """Parts between separators outside brackets, empty ones left out. Angle brackets count as brackets."""
        out, a, angle = [], i, 0
        while i <= end:
            t = self.tok[i]
            if self.kind[i] == "op":
                if t in _OPEN:
                    i = self.close(i)
                elif t == "<":
                    angle += 1
                elif t == ">" and angle:
                    angle -= 1
                elif t == sep and not angle:
                    if a < i:
                        out.append((a, i - 1))
                    a = i + 1
            i += 1
        if a <= end:
            out.append((a, end))
        return out

    def primary(self, i: int, joints: tuple[str, ...]) -> int:
        """First token of the operand that ends at token i: names, calls and indexes joined by ``joints``."""
        while True:
            if self.kind[i] == "op" and self.tok[i] in _CLOSE and i in self.partner and self.partner[i] < i:
                i = self.partner[i]
                if self.is_id(i - 1) or self.at(i - 1) in (")", "]"):
                    i -= 1
                    continue
            if self.at(i - 1) in joints and i >= 2:
                i -= 2
                continue
            return i


def measure(f: Function, branches: list[tuple[int, int]], loops: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(nesting depth, branches, loops) of a function: depth of the deepest branch or loop, counted in those around it. Spans are in order."""
    mine = [x[bisect_left(x, (f.first,)) : bisect_right(x, (f.last + 1,))] for x in (branches, loops)]
    deepest, open_ = 0, []
    for a, b in sorted((*mine[0], *mine[1]), key=lambda s: (s[0], -s[1])):
        while open_ and open_[-1] < a:
            open_.pop()
        deepest = max(deepest, len(open_))
        open_.append(b)
    return deepest, len(mine[0]), len(mine[1])


def within(f: Function, sorted_tokens: list[int]) -> int:
    """How many of the tokens, given in order, lie in the function."""
    return bisect_right(sorted_tokens, f.last) - bisect_left(sorted_tokens, f.first)


def innermost(functions: list[Function], tokens: list[int]) -> list[str]:
    """Name of the innermost function around each token, '' if none; tokens in any order, one sweep over both."""
    out, open_, todo = [""] * len(tokens), [], sorted(functions, key=lambda f: (f.first, -f.last))
    k = 0
    for i in sorted(range(len(tokens)), key=tokens.__getitem__):
        while k < len(todo) and todo[k].first <= tokens[i]:
            while open_ and open_[-1].last < todo[k].first:
                open_.pop()
            open_.append(todo[k])
            k += 1
        while open_ and open_[-1].last < tokens[i]:
            open_.pop()
        if open_:
            out[i] = open_[-1].name
    return out


def put_function(code: Code, rows: Rows, f: Function, complexity: int, branches: list[tuple[int, int]], loops: list[tuple[int, int]], calls: list[int], returns: list[int], statements: list[int], errors: list[int]) -> None:
    """Rows of a function and its fingerprint; unique callees are counted later. Lists of tokens are in order."""
    line = code.line(code.start[f.first])
    depth, n_branches, n_loops = measure(f, branches, loops)
    inside = lambda xs: within(f, xs)
    rows.add("functions", line, f.name, f.visibility, f.params, f.returns, complexity, False)
    rows.add("fn_fingerprints", line, f.name, f.params, complexity, depth, n_branches, n_loops, inside(calls), 0, inside(returns), inside(statements), inside(errors) > 0)


def put_comments(code: Code, rows: Rows, is_doc) -> None:
    for pos, text in code.comments:
        text = text.strip()
        rows.add("comments", code.line(pos), text, "", bool(is_doc(text)))


def put_calls(code: Code, rows: Rows, functions: list[Function], calls: list[tuple[int, int]], external) -> None:
    """``calls``: first and last token of every callee."""
    for (a, b), caller in zip(calls, innermost(functions, [b for _, b in calls]), strict=True):
        callee = code.source(a, b)
        rows.add("calls", code.line(code.start[a]), caller, callee, external(callee))
