"""Rust."""
from __future__ import annotations

import re

from .rows import Rows
from .scan import Code, Function, Syntax, covered, put_calls, put_comments, put_function, within

_SYNTAX = Syntax(
    re.compile(
        r"(?P<comment>//[^\n]*|/\*)|(?P<str>(?:b|c|br|cr|r)(?P<hash>#*)\"[\s\S]*?\"(?P=hash)|[bc]?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')"
        r"|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<id>r#[^\W\d]\w*|'?[^\W\d]\w*)|(?P<op>::|->|=>|\.\.[.=]?|&&|\|\||<<=|>>=|[=!<>+\-*/%&|^]=|[{}()\[\];,.:=<>+\-*/%&|^!?#@$~])|(?P<space>\s+)"
    ),
    frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while".split()) - {"crate"},
    nested_comments=True,
)
_JOINTS = (".", "::")


def extract_rust(text: str, rows: Rows) -> None:
    c = Code(text, _SYNTAX)
    n = len(c.tok)
    # what stands in a macro's brackets is no code to the grammar
    i = 0
    while i < n:
        if c.tok[i] == "!" and c.kind[i - 1] == "id" and c.at(i + 1) in ("(", "[", "{") and not c.word(i - 1, "if", "while", "match", "return", "in"):
            end = c.close(i + 1)
            for k in range(i + 1, end + 1):
                c.dead[k] = True
            i = end
        elif c.word(i, "macro_rules"):
            b = c.find(i, n - 1, "{")
            if b > 0:
                for k in range(i, c.close(b) + 1):
                    c.dead[k] = True
                i = c.close(b)
        elif c.tok[i] == "#" and c.at(i + 1) in ("[", "!"):
            b = i + 1 if c.tok[i + 1] == "[" else i + 2
            if c.at(b) == "[":
                for k in range(i, c.close(b) + 1):
                    c.dead[k] = True
                i = c.close(b)
        i += 1
    live = [i for i in range(n) if not c.dead[i]]

    functions, headers = [], set()
    for i in live:
        if c.names[i] == "fn" and c.is_id(i + 1):
            p = _past_generics(c, i + 2)
            if c.at(p) != "(":
                continue
            q = c.close(p)
            body = _signature_end(c, q + 1)
            if c.at(body) != "{":
                continue  # a signature without a body
            first = i
            while first > 0 and (c.word(first - 1, "pub", "async", "const", "unsafe", "extern", "default") or (c.kind[first - 1] == "str" and c.word(first - 2, "extern")) or (c.tok[first - 1] == ")" and c.word(c.partner.get(first - 1, 0) - 1, "pub"))):
                first = c.partner[first - 1] - 1 if c.tok[first - 1] == ")" else first - 1
            returns = ""
            if c.at(q + 1) == "->":
                stop = body - 1
                w = c.find(q + 2, stop, "where")
                returns = c.source(q + 2, (w if w > 0 else body) - 1).strip()
            params = sum(not _is_self(c, a, b) for a, b in (_without_attributes(c, a, b) for a, b in c.split(p + 1, q - 1)))
            functions.append(Function(c.tok[i + 1], first, c.close(body), params, returns, _visible(c, first)))
            headers.update(range(i, body))

    ifs = [(i, _if_end(c, i)) for i in live if c.names[i] == "if" and not _guard(c, i)]
    matches, arms = [], []
    for i in live:
        if c.names[i] == "match":
            b = _block(c, i + 1)
            if b > 0:
                matches.append((i, c.close(b)))
                arms += _arms(c, b)
    loops = []
    impls = _impl_fors(c)
    for i in live:
        if c.names[i] == "for" and (c.at(i + 1) == "<" or i in impls):
            continue
        if c.word(i, "for", "while", "loop"):
            b = _block(c, i + 1)
            if b > 0:
                loops.append((i, c.close(b)))
    calls = _calls(c, live, headers)
    returns = [i for i in live if c.names[i] == "return"]
    lets = [i for i in live if c.names[i] == "let" and not c.word(i - 1, "if", "while") and c.at(i - 1) != "&&"]
    tries = [i for i in live if c.tok[i] == "?" and c.kind[i] == "op"]
    controls = [a for a, _ in (*ifs, *loops, *matches)]
    statements = lets + returns + controls + _statements(c, live, functions)
    branches, around = sorted(ifs + matches + arms), sorted(loops)
    points, bodies = sorted(a for a, _ in (*branches, *around)), sorted(b for _, b in calls)
    statements.sort()
    for f in functions:
        put_function(c, rows, f, 1 + within(f, points), branches, around, bodies, returns, statements, tries)
    put_calls(c, rows, functions, calls, lambda x: "::" in x or "." in x)
    put_comments(c, rows, lambda t: t.startswith(("///", "//!", "/**")))
    _items(c, rows, live, lets)


def _past_generics(c: Code, i: int) -> int:
    if c.at(i) != "<":
        return i
    depth = 0
    while i < len(c.tok):
        depth += {"<": 1, ">": -1}.get(c.tok[i], 0)
        i += 1
        if not depth:
            break
    return i


def _signature_end(c: Code, i: int) -> int:
    k = c.find(i, len(c.tok) - 1, "{", ";")
    return k if k >= 0 else len(c.tok) - 1


def _without_attributes(c: Code, a: int, b: int) -> tuple[int, int]:
    while c.tok[a] == "#" and c.at(a + 1) == "[" and c.close(a + 1) < b:
        a = c.close(a + 1) + 1
    return a, b


def _is_self(c: Code, a: int, b: int) -> bool:
    k = a
    while k <= b and (c.tok[k] in ("&", "mut") or c.tok[k].startswith("'")):
        k += 1
    return c.at(k) == "self"


def _visible(c: Code, first: int) -> str:
    """public only for plain ``pub``."""
    return "public" if c.word(first, "pub") and c.at(first + 1) != "(" else "private"


def _block(c: Code, i: int) -> int:
    """Brace that opens the block of an if, match or loop whose head starts at i, or -1."""
    return c.find(i, len(c.tok) - 1, "{")


def _if_end(c: Code, i: int) -> int:
    b = _block(c, i + 1)
    end = c.close(b) if b >= 0 else i
    while c.word(end + 1, "else"):
        if c.word(end + 2, "if"):
            b = _block(c, end + 3)
            end = c.close(b) if b >= 0 else end + 2
        else:
            end = c.close(end + 2) if c.at(end + 2) == "{" else end + 2
    return end


def _guard(c: Code, i: int) -> bool:
    """An if between a match arm's pattern and its arrow."""
    k = i + 1
    while k < len(c.tok):
        t = c.tok[k]
        if c.kind[k] == "op" and t in ("(", "["):
            k = c.close(k)
        elif t == "=>":
            return True
        elif t in ("{", "}", ";", ","):
            return False
        k += 1
    return False


def _arms(c: Code, b: int) -> list[tuple[int, int]]:
    out, end, k = [], c.close(b), b + 1
    while k < end:
        arrow = c.find(k, end - 1, "=>")
        if arrow < 0:
            break
        if c.at(arrow + 1) == "{" and c.at(c.close(arrow + 1) + 1) not in (".", "?"):
            stop = c.close(arrow + 1)
            nxt = stop + 1 + (c.at(stop + 1) == ",")
        else:
            comma = c.find(arrow + 1, end - 1, ",")
            stop = (comma if comma > 0 else end) - 1
            nxt = stop + 2
        out.append((k, stop))
        k = nxt
    return out


def _impl_fors(c: Code) -> set[int]:
    """Every for of ``impl Trait for Type``."""
    out, head = set(), False
    for k, t in enumerate(c.tok):
        if c.word(k, "impl"):
            head = True
        elif t in ("{", "}") or (t == ";" and c.at(c.around[k]) != "["):  # not the length of an array
            head = False
        elif head and c.word(k, "for"):
            out.add(k)
    return out


def _enums(c: Code) -> set[int]:
    """Braces of enums."""
    out, head = set(), False
    for k, t in enumerate(c.tok):
        if c.word(k, "enum"):
            head = True
        elif t in ("{", "}", ";"):
            if head and t == "{":
                out.add(k)
            head = False
    return out


def _calls(c: Code, live: list[int], headers: set[int]) -> list[tuple[int, int]]:
    out, enums = [], _enums(c)
    for i in live:
        if c.tok[i] != "(" or c.kind[i] != "op" or i in headers or i == 0:
            continue
        before = i - 1
        if c.tok[before] == ">" and c.kind[before] == "op":  # a turbofish
            depth, k = 0, before
            while k > 0:
                depth += {">": 1, "<": -1}.get(c.tok[k], 0)
                if not depth:
                    break
                k -= 1
            if c.at(k - 1) == "::" and (c.is_id(k - 2) or c.at(k - 2) == ">"):
                out.append((c.primary(k - 2, _JOINTS), before))
        elif (c.is_id(before) and not c.tok[before].startswith("'")) or (c.kind[before] == "op" and c.tok[before] in (")", "]")):
            a = c.primary(before, _JOINTS)
            if c.word(a - 1, "fn", "struct", "enum", "mod") or _in_pattern(c, a, enums) or (c.tok[before] == "]" and c.at(c.partner.get(before, 0) - 1) == "#"):
                continue
            if c.tok[before] == ")" and c.word(c.partner.get(before, 1) - 1, "pub"):
                continue
            out.append((a, before))
    return out


def _in_pattern(c: Code, a: int, enums: set[int]) -> bool:
    """A tuple pattern behind let, or in front of a match arm's arrow, and variants of an enum."""
    k = a
    while k > 0 and c.tok[k - 1] in ("|", "&", "mut", "ref"):
        k -= 1
    if c.word(k - 1, "let"):
        return True
    end = c.close(c.find(a, len(c.tok) - 1, "(")) if c.find(a, len(c.tok) - 1, "(") > 0 else a
    while c.at(end + 1) == "|":
        nxt = c.find(end + 2, len(c.tok) - 1, "(", "=>", ",", ";")
        if nxt < 0 or c.tok[nxt] != "(":
            end = nxt - 1 if nxt > 0 and c.tok[nxt] == "=>" else end
            break
        end = c.close(nxt)
    if c.at(end + 1) == "=>":
        return True
    if c.word(end + 1, "if") and _guard(c, end + 1):
        return True
    return c.brace[a] in enums


def _statements(c: Code, live: list[int], functions: list[Function]) -> list[int]:
    """Expression statements: an expression with a semicolon, or a block-like one that starts a statement."""
    out = []
    starts = {"{", "}", ";"}
    inside = covered(len(c.tok), ((f.first + 1, f.last) for f in functions))
    for i in live:
        if c.tok[i] == ";" and c.kind[i] == "op":
            k = i - 1
            while k > 0 and c.tok[k] not in (";", "{", "}"):
                k = c.partner[k] - 1 if c.tok[k] in (")", "]") and c.partner.get(k, k) < k else k - 1
                if c.tok[k + 1] == "}" and c.partner.get(k + 1, k + 1) < k + 1:
                    break
            first = k + 1
            if c.tok[k] == "}" and c.kind[k] == "op":  # the statement may hold a block
                first = _statement_start(c, i)
            if first < i and not c.word(first, "let", "use", "const", "static", "pub", "struct", "type", "mod", "extern", "fn") and inside[first]:
                if c.around[i] < 0 or c.tok[c.around[i]] != "[":
                    out.append(i)
        elif c.word(i, "if", "match", "for", "while", "loop", "unsafe") and (c.at(i - 1) in starts) and inside[i]:
            end = _if_end(c, i) if c.tok[i] == "if" else c.close(_block(c, i)) if _block(c, i) > 0 else i
            if c.at(end + 1) not in (";", ".", "?") and not _guard(c, i):
                out.append(i)
    return out


def _statement_start(c: Code, i: int) -> int:
    k = i - 1
    while k > 0:
        if c.kind[k] == "op" and c.tok[k] in (")", "]", "}") and c.partner.get(k, k) < k:
            k = c.partner[k] - 1
            continue
        if c.tok[k] in (";", "{"):
            return k + 1
        k -= 1
    return k


def _items(c: Code, rows: Rows, live: list[int], lets: list[int]) -> None:
    structs: dict[str, list] = {}
    for i in live:
        if c.names[i] == "use" and (i == 0 or c.tok[i - 1] in (";", "}", "{", "]", ")") or c.word(i - 1, "pub")):
            end = c.find(i, len(c.tok) - 1, ";")
            first = i
            if c.word(i - 1, "pub"):
                first = i - 1
            elif c.at(i - 1) == ")" and c.word(c.partner.get(i - 1, 0) - 1, "pub"):
                first = c.partner[i - 1] - 1
            text = c.source(first, end if end > 0 else len(c.tok) - 1)
            while text.startswith("use"):
                text = text[3:]
            text = text.strip().rstrip(";")
            parts = text.split(" as ")
            module = parts[0].strip()
            rows.add("imports", c.line(c.start[first]), module, parts[1].strip() if len(parts) > 1 else "", module.split("::")[0] in ("std", "core", "alloc"))
        elif c.word(i, "struct") and c.is_id(i + 1):
            k = _past_generics(c, i + 2)
            b = c.find(k, len(c.tok) - 1, "{", ";", "(")
            fields = len(c.split(b + 1, c.close(b) - 1)) if b > 0 and c.tok[b] == "{" else 0
            first = i - 1 if c.word(i - 1, "pub") else c.partner[i - 1] - 1 if c.at(i - 1) == ")" and c.word(c.partner.get(i - 1, 0) - 1, "pub") else i
            row = rows.add("structs", c.line(c.start[first]), c.tok[i + 1], fields, _visible(c, first), "")
            structs.setdefault(c.tok[i + 1], row)
        elif c.word(i, "impl") and (i == 0 or c.tok[i - 1] in (";", "}", "{", "]") or c.word(i - 1, "unsafe")):
            a = _past_generics(c, i + 1)
            b = c.find(a, len(c.tok) - 1, "{")
            w = c.find(a, b, "where") if b > 0 else -1
            stop = (w if w > 0 else b) - 1
            f = next((k for k in range(a, stop) if c.word(k, "for") and c.at(k + 1) != "<"), -1) if b > 0 else -1
            if f > 0:
                trait, target = _simple(c.source(a, f - 1)), _simple(c.source(f + 1, stop))
                row = structs.get(target)
                if row and trait:  # structs further down, or in other files, are not seen
                    have = [x.strip() for x in row[4].split(",") if x.strip()]
                    row[4] = ",".join([*have, *([trait] if trait not in have else [])])
        elif c.word(i, "const", "static") and (c.is_id(i + 1) or c.word(i + 1, "mut") or c.at(i + 1) == "_") and c.at(i - 1) not in ("*", "<", ",") and not c.word(i + 1, "fn"):
            k = i + 2 if c.word(i + 1, "mut") else i + 1
            if c.at(k + 1) == ":":
                end = c.find(k + 2, len(c.tok) - 1, "=", ";")
                first = i - 1 if c.word(i - 1, "pub") else i
                rows.add("variables", c.line(c.start[first]), c.tok[k], c.source(k + 2, end - 1) if end > 0 else "", "module", c.tok[i] == "static")
    for i in lets:
        k = i + 1
        mutable = c.word(k, "mut")
        k += mutable
        stop = c.find(k, len(c.tok) - 1, ":", "=", ";", "else")
        if stop < 0:
            stop = min(k + 1, len(c.tok) - 1)
        name, hint = c.source(k, stop - 1).strip(), ""
        if c.at(stop) == ":":
            end = c.find(stop + 1, len(c.tok) - 1, "=", ";")
            hint = c.source(stop + 1, (end if end > 0 else len(c.tok)) - 1)
        rows.add("variables", c.line(c.start[i]), name, hint, "function", mutable)


def _simple(name: str) -> str:
    """Last name of a path, before its arguments, without a reference sign; arguments that hold a path leave their rest, as the rule says."""
    return name.rsplit("::", 1)[-1].split("<", 1)[0].strip().lstrip("&")
