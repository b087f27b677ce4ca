"""Python, by lines and tokens, so that text which does not parse still gives its rows."""
from __future__ import annotations

import re
from bisect import bisect_right

from .rows import Rows

#: Modules that count as the standard library.
_STD = frozenset("os sys re math json pathlib typing collections itertools functools datetime subprocess threading asyncio".split())
#: What the grammar names otherwise than the metrics ask: cases of match are not counted, and no assignment lies right under the module.
COUNT_CASES = False
SCOPE = "function"

_TOKEN = re.compile(
    r"(?P<comment>#[^\n]*)|(?P<str>(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?))"
    r"|(?P<num>\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>:=|->|\*\*=?|//=?|>>=?|<<=?|[=!<>+\-*/%&|^@]=|\.\.\.|[()\[\]{},:.;@=<>+\-*/%&|^~!])|(?P<join>\\\n)|(?P<nl>\n)|(?P<space>[^\S\n]+)"
)
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_NO_EXPRESSION = frozenset("pass break continue import from global nonlocal del assert def class async if elif else for while with try except finally return raise".split())


class _Statement:
    """One statement of a logical line: its tokens and the indent of its line."""

    __slots__ = ("indent", "toks")

    def __init__(self, indent: int, toks: list[tuple[str, str, int, int]]):
        self.indent, self.toks = indent, toks

    def word(self, k: int = 0) -> str:
        return self.toks[k][1] if k < len(self.toks) and self.toks[k][0] == "id" else ""


def _statements(text: str, rows: Rows, line) -> list[_Statement]:
    out: list[_Statement] = []
    now: list[tuple[str, str, int, int]] = []
    depth, indent, pos, fresh = 0, 0, 0, True

    def flush() -> None:
        nonlocal now
        if now:
            out.extend(_split(indent, now))
        now = []

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if m is None:
            pos += 1
            continue
        kind, tok = m.lastgroup, m[0]
        if kind == "comment":
            t = tok.strip()
            rows.add("comments", line(pos), t, "", t.startswith(("#:", "#.")))
        elif kind == "nl":
            if not depth:
                flush()
                fresh = True
        elif kind in ("id", "op", "str", "num"):
            if fresh:
                start = text.rfind("\n", 0, pos) + 1
                indent, fresh = len(text[start:pos].expandtabs()), False
                if depth and kind == "id" and tok in ("def", "class", "import"):
                    depth = 0  # a bracket was never closed
            if kind == "op":
                depth += (tok in _OPEN) - (tok in _CLOSE and depth > 0)
            now.append((kind, tok, pos, m.end()))
        pos = m.end()
    flush()
    return out


def _split(indent: int, toks: list[tuple[str, str, int, int]]) -> list[_Statement]:
    """Statements on one logical line: behind semicolons, and behind the colon of a header."""
    out, a, depth, header = [], 0, 0, toks[0][1] if toks[0][0] == "id" else ""
    head = header in ("if", "elif", "else", "for", "while", "with", "try", "except", "finally", "def", "class", "async", "match", "case")
    lambdas = 0
    for k, (kind, tok, *_) in enumerate(toks):
        if kind == "op":
            depth += (tok in _OPEN) - (tok in _CLOSE)
            if not depth and tok == ";":
                out.append(_Statement(indent, toks[a:k]))
                a = k + 1
            elif not depth and tok == ":" and head and not out:
                if lambdas:
                    lambdas -= 1
                    continue
                if header == "match" and k + 1 < len(toks):
                    break  # a name with an annotation
                out.append(_Statement(indent, toks[: k + 1]))
                a = k + 1
                head = False
                indent += 1  # what follows on the line is the body
        elif kind == "id" and tok == "lambda" and not depth:
            lambdas += 1
    if a < len(toks):
        out.append(_Statement(indent, toks[a:]))
    return [s for s in out if s.toks]


def extract_python(text: str, rows: Rows) -> None:
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda pos: bisect_right(breaks, pos - 1) + 1 if pos else 1
    st = _statements(text, rows, line)

    def block(k: int) -> int:
        """Last statement in the body of statement k."""
        e = k
        while e + 1 < len(st) and st[e + 1].indent > st[k].indent:
            e += 1
        return e

    defs = []  # (statement, name, last statement)
    for k, s in enumerate(st):
        o = 1 if s.word() == "async" else 0
        if s.word(o) == "def" and s.word(o + 1):
            defs.append((k, s.word(o + 1), block(k)))

    def enclosing(k: int) -> str:
        best, width = "", None
        for a, name, e in defs:
            if a <= k <= e and (width is None or e - a < width):
                best, width = name, e - a
        return best

    calls = {k: _calls(text, s) for k, s in enumerate(st)}
    assigns = {k: _assignments(text, s) for k, s in enumerate(st)}
    for k, s in enumerate(st):
        for callee, pos in calls[k]:
            rows.add("calls", line(pos), enclosing(k), callee, "." in callee)
        for name, pos in assigns[k]:
            rows.add("variables", line(pos), name, "", SCOPE, True)
        if s.word() in ("import", "from"):
            _import(text, s, rows, line)
        elif s.word() == "class" and s.word(1):
            _class(text, st, k, block(k), rows, line)

    for a, name, e in defs:
        s = st[a]
        spans, kinds = [], {"branch": 0, "loop": 0}
        complexity, returns, statements, errors, n_calls = 1, 0, 0, False, 0
        for k in range(a, e + 1):
            x = st[k]
            w = x.word(1) if x.word() == "async" else x.word()
            n_calls += len(calls[k])
            complexity += sum(t[0] == "id" and t[1] in ("and", "or") for t in x.toks)
            if w in ("if", "elif", "except", "for", "while") or (w == "case" and COUNT_CASES and x.toks[-1][1] == ":"):
                complexity += 1
                kinds["loop" if w in ("for", "while") else "branch"] += 1
                spans.append((k, _chain_end(st, k, block) if w in ("if", "for", "while") else block(k)))
            returns += w == "return"
            errors |= w in ("raise", "try")
            statements += w in ("return", "if", "for", "while", "with", "raise", "try")
            if w not in _NO_EXPRESSION and not (w in ("match", "case") and x.toks[-1][1] == ":"):
                statements += 1 + len(assigns[k])
        deepest, open_ = 0, []
        for p, q in spans:
            while open_ and open_[-1] < p:
                open_.pop()
            deepest = max(deepest, len(open_))
            open_.append(q)
        params, result = _signature(text, s)
        at = line(s.toks[0][2])
        visibility = "private" if name.startswith("_") else "public"
        rows.add("functions", at, name, visibility, params, result, complexity, False)
        rows.add("fn_fingerprints", at, name, params, complexity, deepest, kinds["branch"], kinds["loop"], n_calls, 0, returns, statements, errors)


def _chain_end(st: list[_Statement], k: int, block) -> int:
    """Last statement of an if with its elif and else parts, or of a loop with its else."""
    e = block(k)
    while e + 1 < len(st) and st[e + 1].indent == st[k].indent and st[e + 1].word() in ("elif", "else"):
        e = block(e + 1)
    return e


def _close(toks: list[tuple[str, str, int, int]], i: int) -> int:
    depth = 0
    for k in range(i, len(toks)):
        if toks[k][0] == "op":
            depth += (toks[k][1] in _OPEN) - (toks[k][1] in _CLOSE)
            if not depth:
                return k
    return len(toks) - 1


def _parts(toks: list[tuple[str, str, int, int]], a: int, b: int) -> list[tuple[int, int]]:
    out, start, k = [], a, a
    while k < b:
        if toks[k][0] == "op" and toks[k][1] in _OPEN:
            k = _close(toks, k)
        elif toks[k][1] == ",":
            if start < k:
                out.append((start, k - 1))
            start = k + 1
        k += 1
    if start < b:
        out.append((start, b - 1))
    return out


def _signature(text: str, s: _Statement) -> tuple[int, str]:
    """(parameters counted, result): a typed parameter with a default, and the bare separators, do not count."""
    t = s.toks
    p = next((k for k, x in enumerate(t) if x[1] == "(" and x[0] == "op"), -1)
    if p < 0:
        return 0, ""
    q = _close(t, p)
    n = 0
    for a, b in _parts(t, p + 1, q):
        depth, typed, default = 0, False, False
        for k in range(a, b + 1):
            if t[k][0] == "op":
                depth += (t[k][1] in _OPEN) - (t[k][1] in _CLOSE)
                typed |= not depth and t[k][1] == ":" and not default
                default |= not depth and t[k][1] == "="
        n += not (typed and default) and not (a == b and t[a][1] in ("*", "/"))
    result = ""
    if q + 1 < len(t) and t[q + 1][1] == "->":
        end = len(t) - 1 if t[-1][1] == ":" else len(t)
        result = text[t[q + 2][2] : t[end - 1][3]] if q + 2 < end else ""
    return n, result


def _calls(text: str, s: _Statement) -> list[tuple[str, int]]:
    """(callee, place) of the calls in a statement."""
    t, out = s.toks, []
    o = 1 if s.word() == "async" else 0
    first = 2 + o if s.word(o) in ("def", "class") else 0
    partner, stack = {}, []
    for k, x in enumerate(t):
        if x[0] == "op" and x[1] in _OPEN:
            stack.append(k)
        elif x[0] == "op" and x[1] in _CLOSE and stack:
            partner[k] = stack.pop()
    for k in range(1, len(t)):
        if t[k][1] != "(" or t[k][0] != "op" or k <= first:
            continue
        b = t[k - 1]
        if not ((b[0] == "id" and b[1] not in _KEYWORDS) or b[0] == "str" or (b[0] == "op" and b[1] in (")", "]") and k - 1 in partner)):
            continue
        i = k - 1
        while True:
            if t[i][0] == "op" and t[i][1] in _CLOSE and i in partner:
                i = partner[i]
                if i and ((t[i - 1][0] == "id" and t[i - 1][1] not in _KEYWORDS) or t[i - 1][1] in (")", "]") or t[i - 1][0] == "str"):
                    i -= 1
                    continue
            if i >= 2 and t[i - 1][1] == ".":
                i -= 2
                continue
            break
        out.append((text[t[i][2] : t[k - 1][3]], t[i][2]))
    return out


def _assignments(text: str, s: _Statement) -> list[tuple[str, int]]:
    """(left side, place) of the assignments of a statement: one for each equals sign, or an annotation alone."""
    t = s.toks
    if not t or s.word() in _NO_EXPRESSION or s.word() in ("lambda", "yield", "await", "not"):
        return []
    out, depth, a, colon = [], 0, 0, -1
    for k, x in enumerate(t):
        if x[0] == "id" and x[1] == "lambda" and not depth:
            break
        if x[0] != "op":
            continue
        depth += (x[1] in _OPEN) - (x[1] in _CLOSE)
        if depth:
            continue
        if x[1] == ":" and colon < 0 and not out:
            colon = k
        elif x[1] == "=":
            end = colon if colon > a else k
            if end > a:
                out.append((text[t[a][2] : t[end - 1][3]], t[a][2]))
            a, colon = k + 1, -1
    if not out and 0 < colon < len(t) - 1:
        out.append((text[t[0][2] : t[colon - 1][3]], t[0][2]))
    return out


def _import(text: str, s: _Statement, rows: Rows, line) -> None:
    t = s.toks
    whole = text[t[0][2] : t[-1][3]].strip()
    if s.word() == "from":
        k = next((k for k, x in enumerate(t) if x[0] == "id" and x[1] == "import"), len(t))
        module = text[t[1][2] : t[k - 1][3]] if k > 1 else ""
    else:
        module = whole
        while module.startswith("import "):
            module = module[len("import ") :]
    pos = whole.rfind(" as ")
    rows.add("imports", line(t[0][2]), module, whole[pos + 4 :].strip() if pos >= 0 else "", module in _STD)


def _class(text: str, st: list[_Statement], k: int, end: int, rows: Rows, line) -> None:
    s = st[k]
    name, bases = s.word(1), ""
    if len(s.toks) > 2 and s.toks[2][1] == "(":
        q = _close(s.toks, 2)
        bases = ",".join(text[s.toks[a][2] : s.toks[b][3]] for a, b in _parts(s.toks, 3, q))
    inner = min((st[x].indent for x in range(k + 1, end + 1)), default=0)
    fields = 0
    for x in range(k + 1, end + 1):
        w = st[x].word(1) if st[x].word() == "async" else st[x].word()
        decorated = st[x - 1].toks[0][1] == "@"  # it then lies one level further down
        fields += st[x].indent == inner and w in ("def", "class") and not decorated
    rows.add("structs", line(s.toks[0][2]), name, fields, "private" if name.startswith("_") else "public", bases)
