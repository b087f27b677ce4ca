"""TypeScript and TSX."""
from __future__ import annotations

import re
from bisect import bisect_left

from .rows import Rows
from .scan import Code, Function, Syntax, covered, put_calls, put_comments, put_function, within

_SYNTAX = Syntax(
    re.compile(
        r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<tick>`)|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<num>\d[\w.]*)|(?P<id>[#@]?[^\W\d][\w$]*|\$[\w$]*)"
        r"|(?P<op>=>|\?\.(?!\d)|\?\?=?|\.\.\.|&&=?|\|\|=?|[=!]==?|\*\*=?|\+\+|--|>>>?=?|<<=?|[<>+\-*/%&|^]=|[{}()\[\];,.:=<>+\-*/%&|^!?~])|(?P<space>\s+)"
    ),
    frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null return super switch this throw true try typeof var void while with yield await".split()),
    templates=True,
    regexes=True,
)
_JOINTS = (".", "?.")
#: Modules that count as the standard library, besides those that start with ``node:``.
_STD = frozenset("fs path url util os crypto events stream buffer assert http https tty net".split())
_MODIFIERS = ("public", "private", "protected", "static", "async", "override", "readonly", "abstract", "get", "set", "declare", "accessor")
#: What the grammar names otherwise than the metrics ask: ternaries are not counted, and no declaration lies at module level.
COUNT_TERNARIES = False
SCOPE = "function"


def extract_typescript(text: str, rows: Rows) -> None:
    c = Code(text, _SYNTAX)
    n = len(c.tok)
    functions: list[Function] = []
    headers: set[int] = set()
    members: set[int] = set()  # names of methods
    for i in range(n):
        if c.word(i, "function") and (c.is_id(i + 1) or (c.at(i + 1) == "*" and c.is_id(i + 2))):
            if c.at(i - 1) in ("=", "(", ",", ":", "=>", "return", "?", "||", "&&"):
                headers.add(i + 1)
                continue  # a function expression has no row
            _function(c, functions, headers, i + 1 + (c.at(i + 1) == "*"), i - 1 if c.word(i - 1, "async") else i, method=False)
    classes = []
    for i in range(n):
        if c.word(i, "class") and c.at(i - 1) not in (".",) and (c.is_id(i + 1) or c.at(i + 1) == "{"):
            b = c.find(i + 1, n - 1, "{")
            if b > 0:
                classes.append((i, b, c.close(b)))
                _members(c, functions, headers, members, b)
    for b in range(n):  # methods of object literals
        if c.tok[b] == "{" and c.kind[b] == "op" and c.at(b - 1) in ("(", ",", "=", ":", "[", "return", "?", "=>"):
            _members(c, functions, headers, members, b, literal=True)
    functions.sort(key=lambda f: (f.first, -f.last))

    ifs = [(i, _statement_end(c, i)) for i in range(n) if c.word(i, "if") and c.at(i - 1) != "."]
    fors = [(i, _statement_end(c, i)) for i in range(n) if c.word(i, "for") and c.at(i - 1) != "."]
    whiles = [(i, _statement_end(c, i)) for i in range(n) if c.word(i, "while") and not _of_do(c, i)]
    dos = [(i, c.close(i + 1)) for i in range(n) if c.word(i, "do") and c.at(i + 1) == "{"]
    catches = [(i, c.close(b)) for i in range(n) if c.word(i, "catch") and c.at(i - 1) != "." and (b := c.find(i + 1, n - 1, "{")) > 0]
    cases = _cases(c)
    ternaries = [(i, i) for i in range(n) if c.tok[i] == "?" and c.kind[i] == "op" and c.at(i + 1) not in (":", ")", ",", "(", "=", ";")] if COUNT_TERNARIES else []
    calls = _calls(c, headers, members)
    logic = [i for i in range(n) if c.kind[i] == "op" and c.tok[i] in ("&&", "||")]
    returns = [i for i in range(n) if c.word(i, "return")]
    switches = [i for i in range(n) if c.word(i, "switch")]
    errors = [i for i in range(n) if c.word(i, "try", "throw") and c.at(i - 1) != "."]
    declared = _variables(c, rows)
    statements = declared + returns + switches + errors + [a for a, _ in (*ifs, *fors, *whiles)] + _expressions(c, functions)
    branches, loops = sorted(ifs + cases + ternaries + catches), sorted(fors + whiles + dos)
    points = sorted([a for a, _ in (*ifs, *fors, *whiles, *cases, *catches, *ternaries)] + logic)
    bodies = sorted(b for _, b in calls)
    statements.sort()
    for f in functions:
        put_function(c, rows, f, 1 + within(f, points), branches, loops, bodies, returns, statements, errors)
    put_calls(c, rows, functions, calls, lambda x: "." in x)
    put_comments(c, rows, lambda t: t.startswith(("/**", "///", "/*!")))
    _imports(c, rows)
    for i, b, end in classes:
        if c.is_id(i + 1):
            _class(c, rows, i, b, end)


def _generics(c: Code, i: int) -> int:
    if c.at(i) != "<":
        return i
    depth, k = 0, i
    while k < len(c.tok):
        depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(c.tok[k], 0)
        if depth <= 0:
            return k + 1
        if c.tok[k] in (";", "{", "}", ")", "]"):
            break
        k = c.close(k) + 1 if c.tok[k] in ("(", "[") else k + 1
    return i


def _function(c: Code, functions: list[Function], headers: set[int], k: int, first: int, method: bool) -> bool:
    """A function or method whose name is token k; True if it has a body."""
    p = _generics(c, k + 1)
    if c.at(p) != "(":
        return False
    q = c.close(p)
    b, returns = q + 1, ""
    if c.at(b) == ":":
        b = _type_end(c, b + 1)
        returns = "" if method else c.source(q + 2, b - 1).strip()
    if c.at(b) != "{":
        headers.update(range(k, min(b, len(c.tok))))
        return False
    name = c.tok[k]
    visibility = "public"
    if method:
        marks = [c.tok[x] for x in range(first, k)]
        visibility = "private" if "private" in marks else "internal" if "protected" in marks else "public"
    if name.startswith("_"):
        visibility = "private"
    params = len(c.split(p + 1, q - 1))
    functions.append(Function(name, first, c.close(b), params, returns, visibility))
    headers.update(range(k, b))
    return True


def _type_end(c: Code, i: int) -> int:
    """Token behind a type that starts at i: the brace of a body, or where the declaration ends."""
    fresh = True  # a type is wanted
    while i < len(c.tok):
        t = c.tok[i]
        if t == "{" and c.kind[i] == "op":
            if not fresh:
                return i
            i, fresh = c.close(i) + 1, False
            continue
        if c.kind[i] == "op" and t in ("(", "["):
            i, fresh = c.close(i) + 1, False
            continue
        if t in (";", ",", ")", "}", "="):
            return i
        if t == "<":
            i, fresh = _generics(c, i), False
            if c.at(i) == "<":
                i += 1
            continue
        if t in ("|", "&", "=>", ".", "?", ":") or c.word(i, "is", "keyof", "typeof", "extends", "readonly", "asserts"):
            fresh = True
        elif c.new_line(i) and not fresh:
            return i
        else:
            fresh = False
        i += 1
    return i


def _members(c: Code, functions: list[Function], headers: set[int], members: set[int], b: int, literal: bool = False) -> None:
    """Methods right inside the braces at b."""
    end, i = c.close(b), b + 1
    while i < end:
        first = i
        while c.kind[i] == "id" and (c.tok[i] in _MODIFIERS or c.tok[i].startswith("@")) and c.at(i + 1) not in ("(", "=", ":", ";", "?", "}", ","):
            if c.tok[i].startswith("@"):
                first = i + 1
            i += 1
        if c.kind[i] == "id" and c.tok[i].startswith("@") and c.at(i + 1) == "(":
            i = c.close(i + 1) + 1
            continue
        if c.at(i) == "*":
            i += 1
        if i < end and c.kind[i] in ("id", "str") and c.at(_generics(c, i + 1)) == "(" and not (literal and c.word(i, "function", "if", "for", "while", "switch", "catch", "return")):
            p = _generics(c, i + 1)
            members.add(i)
            if (c.at(c.close(p) + 1) in ("{", ":") or not literal) and _function(c, functions, headers, i, first, method=True):
                i = functions[-1].last + 1
                continue
            if literal:
                return  # a block of statements, no literal
            i = c.close(p) + 1
        # on to the next member
        while i < end and not (c.tok[i] in (";", ",") and c.kind[i] == "op"):
            if i > first and not literal and c.new_line(i) and c.at(i - 1) not in ("=", ":", "=>", "|", "&", "(", ","):
                break
            i = c.close(i) + 1 if c.kind[i] == "op" and c.tok[i] in ("(", "[", "{") else i + 1
        if i < end and c.tok[i] in (";", ","):
            i += 1
        elif i == first:
            i += 1


def _statement_end(c: Code, i: int) -> int:
    """Last token of an if, for or while statement, else branches included."""
    p = i + 1
    if c.word(p, "await"):
        p += 1
    if c.at(p) != "(":
        return i
    end = _body_end(c, c.close(p) + 1)
    while c.tok[i] == "if" and c.word(end + 1, "else"):
        end = _statement_end(c, end + 2) if c.word(end + 2, "if") else _body_end(c, end + 2)
        break
    return end


def _body_end(c: Code, i: int) -> int:
    if c.at(i) == "{":
        return c.close(i)
    if c.word(i, "if", "for", "while"):
        return _statement_end(c, i)
    k = i
    while k < len(c.tok):
        if c.kind[k] == "op" and c.tok[k] in ("(", "[", "{"):
            k = c.close(k)
        elif c.tok[k] == ";":
            return k
        elif c.tok[k] == "}":
            return k - 1
        elif k > i and c.new_line(k) and c.at(k) not in (".", "?.", "?", ":", "&&", "||"):
            return k - 1
        k += 1
    return len(c.tok) - 1


def _of_do(c: Code, i: int) -> bool:
    return c.at(i - 1) == "}" and c.word(c.partner.get(i - 1, 0) - 1, "do")


def _cases(c: Code) -> list[tuple[int, int]]:
    """Cases of switches; default is none."""
    out = []
    for i in range(len(c.tok)):
        if c.word(i, "switch") and c.at(i + 1) == "(" and c.at(c.close(i + 1) + 1) == "{":
            b = c.close(i + 1) + 1
            end, k, open_ = c.close(b), b + 1, -1
            while k <= end:
                if k == end or c.word(k, "case", "default"):
                    if open_ >= 0:
                        out.append((open_, k - 1))
                    open_ = k if c.word(k, "case") else -1
                k = c.close(k) + 1 if k < end and c.kind[k] == "op" and c.tok[k] in ("(", "[", "{") else k + 1
    return out


def _calls(c: Code, headers: set[int], members: set[int]) -> list[tuple[int, int]]:
    out = []
    for i in range(1, len(c.tok)):
        if c.tok[i] != "(" or c.kind[i] != "op" or i in headers:
            continue
        before = i - 1
        if c.tok[before] == "?.":
            before -= 1
        if c.tok[before] == ">" and c.kind[before] == "op":
            k = before
            depth = 0
            while k > 0:
                depth += {">": 1, "<": -1}.get(c.tok[k], 0)
                if not depth:
                    break
                k -= 1
            if not c.is_id(k - 1) or "\n" in c.source(k, before):
                continue
            before = k - 1
        callable_ = c.is_id(before) or c.word(before, "super", "import", "this") or (c.kind[before] == "op" and c.tok[before] in (")", "]") and c.partner.get(before, before) < before)
        if not callable_ or before in members or c.tok[before].startswith("@"):
            continue
        if c.tok[before] == ")" and c.word(c.partner[before] - 1, "if", "for", "while", "switch", "catch", "with"):
            continue
        a = before
        while True:
            a = c.primary(a, _JOINTS)
            if c.at(a - 1) == "!" and a >= 2 and c.at(a) in _JOINTS:
                a -= 2
                continue
            break
        if c.word(a - 1, "new", "function") or c.at(c.close(i) + 1) == "=>" and c.word(before, "async"):
            continue
        out.append((a, i - 1 if c.tok[i - 1] != "?." else before))
    return out


def _expressions(c: Code, functions: list[Function]) -> list[int]:
    """Statements that are an expression."""
    out, types, n = [], _type_bodies(c), len(c.tok)
    inside = covered(n, ((f.first + 1, f.last - 1) for f in functions))
    braces = [i for i, t in enumerate(c.tok) if t == "{"] + [n]
    header = covered(n, ((f.first, min(f.last, braces[bisect_left(braces, f.first)] - 1)) for f in functions))
    for i in range(1, n):
        starts = c.at(i - 1) in (";", "{", "}") or (c.new_line(i) and c.at(i - 1) not in (",", "(", "[", "=", "=>", "&&", "||", "?", ":", "+", "-", ".", "?.", "|", "&") and c.at(i) not in (".", "?.", ")", "]", "}", "?", ":", "&&", "||", ",", "+", "|", "&", "{"))
        if not starts or not inside[i]:
            continue
        if c.is_id(i) or c.word(i, "this", "super", "await", "delete", "new", "yield", "void") or c.at(i) in ("(", "++", "--") or c.kind[i] == "str":
            if c.at(i + 1) == ":" or c.word(i, "type", "interface", "declare", "async") and c.is_id(i + 1):
                continue
            if header[i]:
                continue
            k = c.around[i]
            if k >= 0 and c.tok[k] == "{" and c.at(k - 1) not in ("=", "(", ",", ":", "[", "return", "?", "import", "export") and k not in types:
                out.append(i)
    return out


def _type_bodies(c: Code) -> set[int]:
    """Braces of classes, interfaces and enums."""
    out, head = set(), False
    for k, t in enumerate(c.tok):
        if c.word(k, "class", "interface", "enum"):
            head = True
        elif t in (";", "{", "}", ")"):
            if head and t == "{":
                out.add(k)
            head = False
    return out


def _variables(c: Code, rows: Rows) -> list[int]:
    """Rows of declarators; returns the tokens of the declarations."""
    out = []
    for i in range(len(c.tok) - 1):
        if not c.word(i, "const", "let", "var") or c.at(i - 1) == "." or c.word(i + 1, "enum"):
            continue
        if not (c.is_id(i + 1) or c.at(i + 1) in ("{", "[")):
            continue
        in_for = c.at(i - 1) == "(" and c.word(i - 2, "for", "await")
        k, loop = i + 1, False
        while k < len(c.tok):
            name = (k, c.close(k)) if c.at(k) in ("{", "[") else (k, k)
            e, hint = name[1] + 1, ""
            if c.at(e) == "!":
                e += 1
            if c.at(e) == ":":
                t = _type_end(c, e + 1)
                hint = c.source(e, t - 1)
                e = t
            if in_for and c.word(e, "of", "in"):
                loop = True  # its name belongs to the loop, no declarator
                break
            rows.add("variables", c.line(c.start[k]), c.source(*name), hint, SCOPE, c.tok[i] != "const")
            if c.at(e) == "=":
                depth_end = e + 1
                while depth_end < len(c.tok):
                    t = c.tok[depth_end]
                    if c.kind[depth_end] == "op" and t in ("(", "[", "{", "${"):
                        depth_end = c.close(depth_end)
                    elif t in (",", ";", ")", "}", "]") and c.kind[depth_end] == "op":
                        break
                    elif depth_end > e + 1 and c.new_line(depth_end) and t not in (".", "?.", "?", ":", "&&", "||", "+", "=>", "??") and c.at(depth_end - 1) not in ("=>", "+", "&&", "||", "?", ":", "=", "??", "."):
                        break
                    depth_end += 1
                e = depth_end
            if c.at(e) != "," or c.new_line(e):
                break
            k = e + 1
        if not loop:
            out.append(i)
    return out


def _imports(c: Code, rows: Rows) -> None:
    for i in range(len(c.tok)):
        if not c.word(i, "import") or c.at(i + 1) in ("(", ".") or c.at(i - 1) == ".":
            continue
        k = i + 1
        while k < len(c.tok) and c.kind[k] != "str" and c.tok[k] != ";" and not (k > i + 1 and c.word(k, "import")):
            k += 1
        if k >= len(c.tok):
            continue
        last = k + 1 if c.at(k + 1) == ";" else k
        text = c.source(i, last).strip()
        module = c.tok[k].strip('"') if c.kind[k] == "str" else text.removeprefix("import ")
        pos = text.rfind(" as ")
        alias = text[pos + 4 :].rstrip(";") if pos >= 0 else ""
        rows.add("imports", c.line(c.start[i]), module, alias, module in _STD or module.startswith("node:"))


def _class(c: Code, rows: Rows, i: int, b: int, end: int) -> None:
    name, first = c.tok[i + 1], i - 1 if c.word(i - 1, "abstract") else i
    imp = next((k for k in range(i + 2, b) if c.word(k, "implements")), -1)
    types = ",".join(c.source(*p) for p in c.split(imp + 1, b - 1)) if imp > 0 else ""
    fields, k, fresh = 0, b + 1, True
    while k < end:
        if fresh and c.tok[k] != ";":
            x = k
            while c.kind[x] == "id" and c.tok[x] in _MODIFIERS and c.at(x + 1) not in ("(", "=", ":", ";", "?"):
                x += 1
            p = _generics(c, x + 1)
            is_method = c.at(p) == "("
            has_body = is_method and c.at(_type_end(c, c.close(p) + 2) if c.at(c.close(p) + 1) == ":" else c.close(p) + 1) == "{"
            fields += has_body or not is_method and not c.tok[k].startswith("@")
            fresh = False
        closes = c.kind[k] == "op" and c.tok[k] == "{"
        k = c.close(k) + 1 if c.kind[k] == "op" and c.tok[k] in ("(", "[", "{") else k + 1
        if c.at(k - 1) == ";" or (closes and (c.at(k) != ";" and c.new_line(k))) or (k < end and c.new_line(k) and c.at(k - 1) not in ("=", "=>", ":", "|", "&", ",", "?") and c.at(k) not in (".", "|", "&", "?", "=", "{")):
            fresh = True
    rows.add("structs", c.line(c.start[first]), name, fields, "private" if name.startswith("_") else "public", types)
