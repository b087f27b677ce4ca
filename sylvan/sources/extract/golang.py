"""Go."""
from __future__ import annotations

import re

from .rows import Rows
from .scan import Code, Function, Syntax, put_calls, put_comments, put_function, within

_SYNTAX = Syntax(
    re.compile(
        r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<num>\d[\w.]*)|(?P<id>[^\W\d]\w*)"
        r"|(?P<op>:=|<-|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|<<=?|>>=?|\.\.\.|[{}()\[\];,.:=<>+\-*/%&|^!~])|(?P<space>\s+)"
    ),
    frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
)
#: Node names of the grammar that the metrics ask for. Those of switches and their cases are not the grammar's own, so they count nothing; turn this on to count them.
COUNT_SWITCHES = False
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="])


def _exported(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def extract_go(text: str, rows: Rows) -> None:
    c = Code(text, _SYNTAX)
    n = len(c.tok)
    functions: list[Function] = []
    headers: set[int] = set()  # tokens of declarations' names and parameters, where no call can be
    i = 0
    while i < n:
        if c.word(i, "func") and (c.is_id(i + 1) or (c.at(i + 1) == "(" and c.is_id(c.close(i + 1) + 1) and c.at(c.close(i + 1) + 2) in ("(", "["))):
            k = i + 1 if c.is_id(i + 1) else c.close(i + 1) + 1
            p = k + 1
            if c.at(p) == "[":
                p = c.close(p) + 1
            if c.at(p) == "(":
                q = c.close(p)
                params = _groups(c, p, q)
                body, returns = _result(c, q + 1)
                functions.append(Function(c.tok[k], i, c.close(body) if body >= 0 else max(q, returns[1]), params, c.source(*returns), _exported(c.tok[k])))
                headers.update(range(i, (body if body >= 0 else q + 1)))
        i += 1

    ifs = [(i, _if_end(c, i)) for i in range(n) if c.word(i, "if")]
    fors = [(i, _block_end(c, i)) for i in range(n) if c.word(i, "for")]
    selects = [(i, _block_end(c, i)) for i in range(n) if c.word(i, "select")]
    switches = [(i, _block_end(c, i)) for i in range(n) if c.word(i, "switch")] if COUNT_SWITCHES else []
    calls = _calls(c, headers)
    returns = [i for i in range(n) if c.word(i, "return")]
    statements = _statements(c, calls) + returns + [a for a, _ in (*ifs, *fors, *switches)] + [i for i in range(n) if c.word(i, "go", "defer")]
    extra = [i for i in range(n) if c.word(i, "range", "go")]
    branches, loops = sorted(ifs + selects + switches), sorted(fors)
    points, bodies = sorted([a for a, _ in (*branches, *loops)] + extra), sorted(b for _, b in calls)
    statements.sort()
    for f in functions:
        put_function(c, rows, f, 1 + within(f, points), branches, loops, bodies, returns, statements, [i for i in range(f.first, f.last + 1) if c.word(i, "defer")])
    put_calls(c, rows, functions, calls, lambda x: "." in x)
    put_comments(c, rows, lambda t: t.startswith("/*") or (t.startswith("// ") and t[3:4].isupper()))
    _imports(c, rows)
    _types(c, rows)
    _variables(c, rows, functions)


def _groups(c: Code, p: int, q: int) -> int:
    """Parameter groups: names that share one type are one group; a variadic one does not count."""
    parts = c.split(p + 1, q - 1)
    named = any(b > a and c.is_id(a) and c.at(a + 1) != "." for a, b in parts)
    if named:  # a lone name takes the type of a later part, so it is in that group
        return sum(b > a and not any(c.tok[x] == "..." for x in range(a, b + 1)) for a, b in parts)
    return sum(not c.tok[a] == "..." for a, _ in parts)


def _result(c: Code, i: int) -> tuple[int, tuple[int, int]]:
    """(token of the body's brace or -1, tokens of the result) behind the parameters."""
    a = i
    while i < len(c.tok):
        t = c.tok[i]
        if t == "{":
            if c.word(i - 1, "interface", "struct"):
                i = c.close(i) + 1
                continue
            return i, (a, i - 1)
        if t in ("(", "["):
            i = c.close(i)
        elif (c.new_line(i) and i > a) or t in (";", "}"):
            return -1, (a, i - 1)
        elif c.new_line(i) and i == a:
            return -1, (a, a - 1)
        i += 1
    return -1, (a, i - 1)


def _block_end(c: Code, i: int) -> int:
    """Last token of the statement whose block is the first one behind i."""
    b = i + 1
    while 0 <= b < len(c.tok):
        b = c.find(b, len(c.tok) - 1, "{")
        if b < 0:
            return i
        if c.word(b - 1, "interface", "struct"):
            b = c.close(b) + 1
            continue
        return c.close(b)
    return i


def _if_end(c: Code, i: int) -> int:
    end = _block_end(c, i)
    while c.word(end + 1, "else"):
        nxt = end + 2
        end = _block_end(c, nxt) if c.word(nxt, "if") else c.close(nxt) if c.at(nxt) == "{" else nxt
    return end


def _calls(c: Code, headers: set[int]) -> list[tuple[int, int]]:
    out, literals = [], _literal_bodies(c)
    for i in range(1, len(c.tok)):
        if c.tok[i] != "(" or c.kind[i] != "op" or i in headers or c.new_line(i):
            continue
        before = i - 1
        if c.is_id(before) or (c.kind[before] == "op" and c.tok[before] in (")", "}")):
            literal = literals.get(c.partner.get(before, -1)) if c.tok[before] == "}" else None
            if c.tok[before] == "}" and literal is None:
                continue
            if c.tok[before] == ")" and c.word(c.partner.get(before, 0) - 1, "func"):
                continue  # the result list of a function literal
            a = c.primary(before, (".",)) if literal is None else literal
            if not c.word(a - 1, "func", "type") and not _in_interface(c, i):
                out.append((a, before))
        elif c.tok[before] == "]" and before in c.partner and c.is_id(c.partner[before] - 1) and not c.word(c.partner[before] - 1, "map"):
            out.append((c.primary(before, (".",)), before))
    return out


def _literal_bodies(c: Code) -> dict[int, int]:
    """First token of every function literal, by the brace of its body."""
    out: dict[int, int] = {}
    for i in range(len(c.tok)):
        if c.word(i, "func") and c.at(i + 1) == "(":
            body = _result(c, c.close(i + 1) + 1)[0]
            if body >= 0 and c.around[body] == c.around[i]:
                out.setdefault(body, i)  # the first one's result may be a function type
    return out


def _in_interface(c: Code, i: int) -> bool:
    """A method of an interface, which stands at the start of a line right inside its braces."""
    if not c.new_line(i - 1):
        return False
    return c.brace[i] >= 0 and c.word(c.brace[i] - 1, "interface")


def _statements(c: Code, calls: list[tuple[int, int]]) -> list[int]:
    """Short declarations, assignments, and calls and receives that stand as statements."""
    out = []
    for i, t in enumerate(c.tok):
        if c.kind[i] != "op":
            continue
        if t == ":=":
            a = i
            while a > 0 and not c.new_line(a) and c.tok[a - 1] not in ("{", "}", ";", ":"):
                a -= 1
            if not c.word(i + 1, "range") and not c.word(a, "case") and not (c.word(a, "switch") and any(c.word(x, "type") for x in range(i, min(len(c.tok), i + 12)))):
                out.append(i)
        elif t in _ASSIGN:
            a = i
            while a > 0 and not c.new_line(a) and c.tok[a - 1] not in ("{", "}", ";"):
                a -= 1
            if not c.word(a, "var", "const", "type") and not c.word(i + 1, "range") and not _in_group(c, a):
                out.append(i)
    for a, b in calls:
        end = c.close(b + 1)
        first = c.new_line(a) or c.at(a - 1) in ("{", "}", ";", ":")
        last = end + 1 >= len(c.tok) or c.new_line(end + 1) or c.at(end + 1) in (";", "}")
        if first and last and c.at(end + 1) not in (".",) and not (c.new_line(a) and c.at(a - 1) in ("(", ",", ".")):
            out.append(a)
    out += [i for i, t in enumerate(c.tok) if t == "<-" and (c.new_line(i) or c.at(i - 1) in ("{", ";"))]
    return out


def _in_group(c: Code, a: int) -> bool:
    """Inside the parentheses of a grouped var or const."""
    k = c.around[a]
    return c.at(k) == "(" and c.word(k - 1, "var", "const", "type", "import")


def _imports(c: Code, rows: Rows) -> None:
    def spec(i: int) -> int:
        alias = ""
        if c.kind[i] == "id" or c.tok[i] == ".":
            alias, i = c.tok[i], i + 1
        if i < len(c.tok) and c.kind[i] == "str":
            module = c.tok[i].strip('"')
            a = i - 1 if alias else i
            rows.add("imports", c.line(c.start[a]), module, alias, "." not in module)
        return i + 1

    for i in range(len(c.tok) - 1):
        if c.word(i, "import"):
            if c.tok[i + 1] == "(":
                k, end = i + 2, c.close(i + 1)
                while k < end:
                    k = spec(k) if c.tok[k] != ";" else k + 1
            else:
                spec(i + 1)


def _types(c: Code, rows: Rows) -> None:
    def spec(i: int) -> int:
        name, k = c.at(i), i + 1
        if c.at(k) == "[" and c.is_id(k + 1):
            k = c.close(k) + 1
        if c.word(k, "struct") and c.at(k + 1) == "{":
            end, fields, j = c.close(k + 1), 0, k + 2
            while j < end:
                fields += c.new_line(j) or c.at(j - 1) in ("{", ";")
                j = c.close(j) + 1 if c.tok[j] in ("{", "(", "[") and c.kind[j] == "op" else j + 1
            rows.add("structs", c.line(c.start[i]), name, fields, _exported(name), "")
            return end + 1
        while k < len(c.tok) and not c.new_line(k) and c.tok[k] != ")":
            k = c.close(k) + 1 if c.tok[k] in ("{", "(", "[") and c.kind[k] == "op" else k + 1
        return k

    for i in range(len(c.tok) - 1):
        if c.word(i, "type") and (c.is_id(i + 1) or c.tok[i + 1] == "(") and c.at(i - 1) not in (".", "("):
            if c.tok[i + 1] == "(":
                k, end = i + 2, c.close(i + 1)
                while k < end:
                    k = spec(k) if c.is_id(k) else k + 1
            else:
                spec(i + 1)


def _variables(c: Code, rows: Rows, functions: list[Function]) -> None:
    """Single var declarations and short ones; grouped var declarations and constants give nothing."""
    for i in range(len(c.tok) - 1):
        if c.word(i, "var") and c.is_id(i + 1):
            k = i + 2
            while c.at(k) == "," and c.is_id(k + 1):
                k += 2
            a = k
            while k < len(c.tok) and not c.new_line(k) and c.tok[k] not in ("=", ";"):
                k = c.close(k) + 1 if c.tok[k] in ("{", "(", "[") and c.kind[k] == "op" else k + 1
            inside = any(f.first <= i <= f.last for f in functions)
            rows.add("variables", c.line(c.start[i + 1]), c.tok[i + 1], c.source(a, k - 1), "function" if inside else "package", False)
        elif c.tok[i] == ":=" and not c.word(i + 1, "range"):
            a = i
            while a > 0 and not c.new_line(a) and c.tok[a - 1] not in ("{", "}", ";", ":") and not c.word(a - 1, "if", "for", "switch", "case", "select"):
                a -= 1
            if not c.word(a - 1, "case", "switch") or (c.word(a - 1, "switch") and not any(c.word(x, "type") for x in range(i, min(len(c.tok), i + 12)))):
                rows.add("variables", c.line(c.start[a]), c.source(a, i - 1), "", "function", True)
