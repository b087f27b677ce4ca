"""Natural language hidden inside code: a character-level hidden Markov model with states for code and nine languages."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ensure_importable

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
#: The last state takes text of a script that none of the nine languages explains, so it is not given to the nearest one.
STATES = ("code", *LANGS, "other")
_ZH, _JA, _RU, _OTHER = STATES.index("zh"), STATES.index("ja"), STATES.index("ru"), STATES.index("other")
#: States that text of Latin letters alone can be in.
_LATIN = np.array([k for k in range(len(STATES)) if k not in (_ZH, _JA, _RU)])
#: Least words, and least Chinese or Japanese characters, of running text.
LEAST_WORDS, LEAST_CHARS = 5, 8
#: The model is fitted on about so many rows and characters, whatever the size of the table: those of smallest text hash.
SAMPLE, SAMPLE_CHARS = 6_000, 4_000_000
#: Characters of one observed sequence; a longer text is cut at the end of a line or word.
SEQUENCE = 2000
#: Characters decoded together.
GROUP = 2_000_000
#: Kinds of places between two characters, and the cost in nats of changing state there, before it is fitted, and its bounds.
WITHIN, SPACE, QUOTE, LINE = range(4)
FIRST_COST = (16.0, 13.0, 4.0, 2.5)
#: Cost in nats of a letter in the last state: more than an unusual word of a known language costs a letter, less than words with letters it lacks.
OTHER_LETTER = 4.0
COST_BOUNDS = ((16.0, 22.0), (14.0, 20.0), (2.5, 8.0), (1.5, 6.0))

#: Common words from which the first labels of the sample are taken.
COMMON = {
    "en": "the of and is are to in for with by from this that be it not at each if when only all has which after while as an on was any every",
    "de": "der die das und ist nicht mit für fuer den dem ein eine einer eines von zu im auf wird werden auch wenn aus bei nach alle noch nur sich damit bevor",
    "fr": "le la les des du de et est une un dans pour par sur avec qui que ne pas ce cette aux au sans sous si même afin chaque tous",
    "es": "el la los las de del y es una un en para por con que no se al lo como si más sin su está antes cada todos",
    "pt": "o a os as do da dos das de e é um uma em no na nos nas para por com que não nao se ao mais sem já ja antes cada todos",
    "it": "il lo la i gli le di del della dei delle e è un una in per con che non si al alla più sono ogni prima senza tutti",
}
#: Text that keeps the model sane where the sample has little of a state.
_BASE = {
    "code": "return x; if (a == b) { c(d); } let m = n.o(p)?; q := r.s(ctx) for _, t := range u { const v = await w.x(); self.y = z[0:] print(\"%s\", e) def i(j): k = l.m(n=1) "
    "\nselect distinct name, city from users left join orders on id = user_id inner join items where id in (select id from t) group by city having count(*) > 1 order by name desc limit 10;"
    "\nselect name from users left join orders where total > 5\ninsert into table values (1, 2)\ninsert into users select distinct city from people\nupdate users set name = null where id is not null\ndelete from orders where id between 1 and 9\ncreate table t primary key not null default"
    "\nclass foo extends bar implements baz\npublic static final void main\nimport a from b\nexport default function\nif x is not none and y in z: pass\nelse: break\nwhile true: continue\ntry except finally raise\nfor i in range n yield async await lambda\nfn impl struct enum match mut pub use mod type interface switch case select chan defer go func package var",
    "en": "the following options are supported by this command. returns true if there is nothing left to do, otherwise the number of items in the list. this should not happen, but we check it anyway because some callers pass an empty value here. see also the function below which does the same thing for whole files. note that the default may change in future versions.",
    "de": "die folgenden optionen werden von diesem befehl unterstützt. gibt wahr zurück, wenn es nichts mehr zu tun gibt, sonst die anzahl der einträge in der liste. das sollte nicht vorkommen, wir prüfen es aber trotzdem, weil manche aufrufer hier einen leeren wert übergeben. siehe auch die funktion unten, die dasselbe für ganze dateien macht.",
    "fr": "les options suivantes sont prises en charge par cette commande. renvoie vrai s'il ne reste rien à faire, sinon le nombre d'éléments de la liste. cela ne devrait pas arriver, mais nous le vérifions quand même parce que certains appelants passent une valeur vide ici. voir aussi la fonction ci-dessous qui fait la même chose pour des fichiers entiers.",
    "es": "las siguientes opciones son compatibles con este comando. devuelve verdadero si no queda nada por hacer, de lo contrario el número de elementos de la lista. esto no debería ocurrir, pero lo comprobamos de todos modos porque algunos llamadores pasan aquí un valor vacío. véase también la función de abajo, que hace lo mismo para archivos enteros.",
    "pt": "as seguintes opções são suportadas por este comando. devolve verdadeiro se não houver mais nada a fazer, caso contrário o número de itens da lista. isto não deveria acontecer, mas verificamos assim mesmo porque alguns chamadores passam aqui um valor vazio. veja também a função abaixo, que faz o mesmo para arquivos inteiros.",
    "it": "le seguenti opzioni sono supportate da questo comando. restituisce vero se non c'è più nulla da fare, altrimenti il numero di elementi della lista. questo non dovrebbe accadere, ma lo controlliamo comunque perché alcuni chiamanti passano qui un valore vuoto. vedi anche la funzione qui sotto, che fa la stessa cosa per file interi.",
    "ru": "и не для при как без под над все это. возвращает истину, если больше нечего делать, иначе число элементов списка. этого не должно быть, но мы всё равно проверяем, потому что некоторые вызывающие передают пустое значение. смотри также функцию ниже, которая делает то же самое для целых файлов. следующие параметры поддерживаются этой командой. заметьте, что поведение по умолчанию может измениться в будущих версиях, поэтому лучше указать его явно. если во время чтения произошла ошибка, работа продолжается со следующей строки.",
    "zh": "的一是不在有了和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处理世车点",
    "ja": "のはをにがとでたしてれさあいうえおかきくけこ文書名前順番並べ読み込んで処理する、これはすべての項目です。",
}

_ACCENTED = "äöüßéèêëàâáãåçñíìîïóòôõúùûýœæ"
#: Letters of the Cyrillic script by themselves: those of Russian, then those of its neighbours.
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё" + "іїєґўљњћџђјѓќѕ"
#: Symbols of the Latin table: space, letters, then kinds of signs; those that code is full of stand by themselves.
_SIGNS = {"'’": 0, "\x01": 1, "\x02": 2, '"': 3, ".!?…": 4, ",": 5, ":": 6, "-–—": 7, "(": 8, ")": 9, "{}": 10, "=<>": 11, "[]": 12, ";": 13, "\n": 14, "`": 15}
_SIGN0 = 27 + len(_ACCENTED)
_DIGIT, _SIGN, _FOREIGN = _SIGN0 + 16, _SIGN0 + 17, _SIGN0 + 18
_NA = _FOREIGN + 1
#: Symbols of the Cyrillic table: space, any other sign, letters, a rare letter; of the Chinese and Japanese one: anything else, hiragana, katakana, their signs, groups of characters.
_NC = 3 + len(_CYRILLIC)
_GROUPS = 61
_NH = 4 + _GROUPS


def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script (0 Latin and signs, 1 Cyrillic, 2 Chinese and Japanese), symbol in each table, and whether it is a letter."""
    n = 0x10000
    script, la, cy, ha = np.zeros(n, np.int8), np.full(n, _SIGN, np.int32), np.ones(n, np.int32), np.zeros(n, np.int32)
    letter = np.fromiter((chr(k).isalpha() for k in range(n)), bool, n)
    signs = {c: v for cs, v in _SIGNS.items() for c in cs}
    for k in range(n):
        c = chr(k)
        if c in signs:
            la[k] = _SIGN0 + signs[c]
        elif c.isspace():
            la[k] = cy[k] = 0
        elif "a" <= c <= "z":
            la[k] = k - 96
        elif c in _ACCENTED:
            la[k] = 27 + _ACCENTED.index(c)
        elif c.isdigit():
            la[k] = _DIGIT
        elif 0x400 <= k < 0x530:
            script[k], la[k], cy[k] = 1, _FOREIGN, 2 + (_CYRILLIC.index(c) if c in _CYRILLIC else len(_CYRILLIC))
        elif 0x3040 <= k < 0x30A0 or 0x30A0 <= k < 0x3100 or k == 0xFF66:
            script[k], la[k], ha[k] = 2, _FOREIGN, 1 if k < 0x30A0 else 2
        elif c in "、。，：！？；「」（）・《》":
            script[k], la[k], ha[k] = 2, _FOREIGN, 3
        elif 0x3400 <= k < 0x4DC0 or 0x4E00 <= k < 0xA000 or 0xF900 <= k < 0xFB00 or k == 0x3005:
            script[k], la[k], ha[k] = 2, _FOREIGN, 4 + k * 40503 % 65536 % _GROUPS
    return script, la, cy, ha, letter


_SCRIPT, _LA, _CY, _HA, _LETTER = _alphabet()
_CY0, _HA0 = _NA**3, _NA**3 + _NC**3
_ROWS = _HA0 + _NH**2

# --- from a comment to its observed sequences ---

_CP1252 = {c.encode("latin-1").decode("cp1252", "ignore"): c for c in map(chr, range(0x80, 0xA0))}
_CP1252.pop("", None)
_GARBLED = re.compile(f"[\x80-\xff{''.join(map(re.escape, _CP1252))}]{{2,}}")


def _regarble(m: re.Match) -> str:
    raw = bytes(ord(_CP1252.get(c, c)) for c in m[0])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repair(text: str) -> str:
    """Undo UTF-8 that was decoded as a one-byte code page."""
    return _GARBLED.sub(_regarble, text)


_ESCAPE = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})|\\([ntrfv\"'\\/`])|(&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,8});)")


def _resolve(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        k = int(code, 16)
        return chr(k) if k < 0x110000 and not 0xD800 <= k < 0xE000 else " "
    return html.unescape(m[5]) if m[5] else m[4] if m[4] in "\"'\\/`" else " "


def unescape(text: str) -> str:
    return _ESCAPE.sub(_resolve, text) if "\\" in text or "&" in text else text


_MARKER = re.compile(r"^[^\S\n]*(?:(?:/\*[*!]?|\*/|\*(?!\*)|//[/!]?|#[:.!]?|--(?!-)|\"\"\"|\'\'\')[^\S\n]*)*", re.MULTILINE)
_END_MARKER = re.compile(r"(?:\*+/|\"\"\"|\'\'\')[^\S\n]*$", re.MULTILINE)
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|(?<=[(=,\[{+\s])'((?:[^'\\\n]|\\.)*)'(?=\s*(?:[),;\]}+]|$))", re.MULTILINE)
_TRAILING = re.compile(r"[^\S\n](?://+|#+|/\*+)[^\S\n]")
#: A note's label in front of its text, as in ``fixme(name): ...``.
_LABEL = re.compile(r"^[^\S\n]*[^\W\d_]+\([\w ,.@-]*\):[^\S\n]", re.MULTILINE)
#: Identifiers, paths, directives and other signs that are no running text, and calls; each becomes one mark. What may hold spaces comes first, the rest lies inside a word.
_SPACED_ID = re.compile(r"`[^`\n]*`|<[^<>\n]*>")
_ID = re.compile(
    r"(?P<call>(?<!\w)\w+(?:(?:\.|::)\w+)*\()|[@#$][\w{][\w}]*|(?<!\w)(?:\w+://\S+|\w+(?:(?:\.|::|->|=|\\)\w+)+|\w*_\w*|\w*\d\w*|\w*[a-z][A-Z][a-z]\w*|\w+:(?=\S))"
    r"|(?<![\w.~/-])(?:[\w.~-]*/)+[\w.~-]+(?::\d+)*|[{%]\w?\}?|--?\w+=?[^\s]*",
    re.ASCII,
)


def _mark(m: re.Match) -> str:
    return "\x02" if m.lastgroup else "\x01"


@lru_cache(maxsize=200_000)
def _observed_word(word: str) -> str:
    # one letter, whose lower case is two characters, would make a text longer
    return (word if word.isalpha() and word[1:].islower() else _ID.sub(_mark, word)).replace("İ", "I").lower()


def plain_lines(text: str) -> str:
    """A comment without its markers; a trailing comment behind code begins a line of its own."""
    text = "\n".join((text if text.isascii() else repair(text)).splitlines())
    if "\n" in text:
        text = _MARKER.sub("", text)
    else:
        text = text[_MARKER.match(text).end() :]
    if "*/" in text or '"""' in text or "'''" in text:
        text = _END_MARKER.sub("", text)
    if "):" in text:
        text = _LABEL.sub("", text)
    return _TRAILING.sub("\n", text) if "/" in text or "#" in text else text


def observed(text: str) -> str:
    """What the model reads: unescaped, in lower case, with a mark for every identifier and call. Never longer than ``text``."""
    text = unescape(text)
    if "`" in text or "<" in text:
        text = _SPACED_ID.sub("\x01", text)
    return " ".join(map(_observed_word, text.replace("\n", " \n ").split(" "))).replace(" \n ", "\n").strip()


def pieces(text: str) -> list[str]:
    """The observed sequences of a text: the whole of it, or parts of at most SEQUENCE characters that end with a line or word."""
    out, at = [], 0
    while len(text) - at > SEQUENCE:
        end = max(text.rfind("\n", at + 1, at + SEQUENCE), at)
        if end == at:
            end = max(text.rfind(" ", at + 1, at + SEQUENCE), at)
        end = end if end > at else at + SEQUENCE
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return [p for p in out if p]


#: A line that is surely code; only used to label the sample, where its literals are read on their own.
_CODE = re.compile(r"[{}]\s*$|:=|=>|[=!]=|->|\w\(|^\s*(?:let|const|var|return|def|func|fn|import|export|defer|del|raise|throw|match)\s.*[()\[\]{};=]|^\s*\w+(?:\.\w+)*\s*=\s|\|.*\||^\s*\$\s")


def labelled_lines(text: str) -> list[tuple[str, bool]]:
    """(observed sequence, whether it is surely code) of the lines of a comment of the sample."""
    out = []
    for line in plain_lines(text).split("\n"):
        outside = _LITERAL.sub('""', line)
        if _CODE.search(outside):
            out.append((observed(outside), True))
            out += [(observed(m[1] if m[1] is not None else m[2]), False) for m in _LITERAL.finditer(line)]
        else:
            out.append((observed(line), False))
    return [(p, code) for s, code in out for p in pieces(s)]


# --- the model ---


def _points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)


def _codes(u: np.ndarray) -> np.ndarray:
    """Row of the emission table for every character: a trigram of its script, or a pair of Chinese or Japanese ones. A text begins with a line end."""
    la = _LA[u]
    before = np.concatenate([[_LA[10], _LA[10]], la])
    out = (before[:-2] * _NA + before[1:-1]) * _NA + la
    script = _SCRIPT[u]
    if script.any():
        cy, ha = np.concatenate([[1, 1], _CY[u]]), np.concatenate([[0], _HA[u]])
        out = np.where(script == 1, _CY0 + (cy[:-2] * _NC + cy[1:-1]) * _NC + cy[2:], out)
        out = np.where(script == 2, _HA0 + ha[:-1] * _NH + ha[1:], out)
    return out


def _places(u: np.ndarray) -> np.ndarray:
    """Kind of the place in front of every character."""
    last = np.concatenate([[10], u[:-1]])
    letter, before = _LETTER[u], _LETTER[last]
    out = np.where(letter & before, WITHIN, SPACE).astype(np.int8)
    quote = lambda x: (x == 34) | (x == 96)
    # an apostrophe opens or closes a literal only where no letters stand on both of its sides
    out[quote(u) | quote(last) | ((last == 39) & ~np.concatenate([[False], before[:-1]])) | ((u == 39) & ~np.concatenate([letter[1:], [False]]))] = QUOTE
    out[last == 10] = LINE
    return out


def _first_label(text: str, code: bool) -> int | None:
    """State of a sequence by its script, or by its common words if one language clearly leads."""
    if code:
        return 0
    u = _points(text)
    script, kana = np.bincount(_SCRIPT[u], minlength=3), np.isin(_HA[u], (1, 2)).sum()
    if kana >= 2:
        return _JA
    if script[2] >= 4:
        return _ZH
    if script[1] >= 4:
        return _RU if np.isin(_CY[u], range(2 + 33, _NC)).sum() * 50 < script[1] else _OTHER
    score = np.zeros(len(STATES))
    for w in re.findall(r"[^\W\d_]+", text):
        for k, share in _VOTES.get(w, ()):
            score[k] += share
    a, b = np.sort(score)[:-3:-1]
    return int(score.argmax()) if a >= 1.5 and a >= 2 * b else None


_VOTES: dict[str, list[tuple[int, float]]] = {}
for _l, _ws in COMMON.items():
    for _w in _ws.split():
        _VOTES.setdefault(_w, []).append((STATES.index(_l), 0.0))
_VOTES = {w: [(k, 1 / len(v)) for k, _ in v] for w, v in _VOTES.items()}


class Model(NamedTuple):
    """Emissions as [row, state], the last row being 0 for padding, and the cost of a change of state by the kind of place."""

    table: np.ndarray
    cost: np.ndarray


def _smoothed(n: np.ndarray, k2: float = 8, k3: float = 4) -> np.ndarray:
    """log P(symbol | symbols before), interpolated with shorter contexts."""
    flat = n.sum(tuple(range(n.ndim - 1)))
    p = (flat + 0.02) / (flat.sum() + 0.02 * len(flat))
    if n.ndim == 3:
        two = n.sum(0)
        p = (two + k2 * p) / (two.sum(1, keepdims=True) + k2)
    return np.log((n + k3 * p) / (n.sum(-1, keepdims=True) + k3)).reshape(-1)


def _emissions(labelled: list[tuple[np.ndarray, int]]) -> np.ndarray:
    table = np.zeros((_ROWS + 1, len(STATES)), np.float32)
    for k, state in enumerate(STATES):
        base = _codes(_points(f"{_BASE.get(state, '')} {COMMON.get(state, '')}"))
        n = np.bincount(np.concatenate([base] * 4 + [c for c, s in labelled if s == k]), minlength=_ROWS).astype(float)
        parts = [n[:_CY0].reshape(_NA, _NA, _NA), n[_CY0:_HA0].reshape(_NC, _NC, _NC), n[_HA0:].reshape(_NH, _NH)]
        if state == "other":  # letters of a script without any order among them, and never the better choice for a sign
            flat = np.full(_NA, -np.log(28.0))
            flat[0], flat[_SIGN0:] = -1.0, -5.0
            table[:-1, k] = np.concatenate([np.log(0.2) + np.tile(flat, _NA * _NA), np.full(_NC**3, -OTHER_LETTER), np.full(_NH**2, -9.0)])
            continue
        script = np.array([x.sum() for x in parts]) + (1.0, 0.02, 0.02)
        table[:-1, k] = np.concatenate([np.log(q / script.sum()) + _smoothed(x) for q, x in zip(script, parts, strict=True)])
    return table


def fit(texts: list[str]) -> Model:
    """The model of comments: emissions from first labels by common words and script, then once more from the model's own; then the cost of a change, from the paths it finds."""
    seqs = [(_codes(_points(t)), t, code) for x in texts for t, code in labelled_lines(x)]
    table = _emissions([(c, k) for c, t, code in seqs if (k := _first_label(t, code)) is not None])
    again = []
    for c, t, code in seqs:
        total = table[c].sum(0)
        if code:
            again.append((c, 0))
        elif len(c) >= 12:
            best, second = np.sort(total)[:-3:-1]
            if best - second > 6:
                again.append((c, int(total.argmax())))
    model = Model(_emissions(again), np.array(FIRST_COST, np.float32))
    seen = changed = np.zeros(len(FIRST_COST))
    for _, seqs in _groups(texts):
        u, path, seq = _decoded(seqs, model)
        at, same = _places(u)[1:], np.diff(np.flatnonzero(np.diff(seq, prepend=-1)), append=len(u))
        inside = np.ones(len(u), bool)
        begin = np.cumsum(same) - same
        inside[np.concatenate([begin, begin + 1, np.minimum(begin + 2, len(u) - 1)])] = False  # the line ends and the first character
        inside = inside[1:]
        seen = seen + np.bincount(at[inside], minlength=len(seen))
        changed = changed + np.bincount(at[inside & (path[1:] != path[:-1])], minlength=len(seen))
    low, high = np.array(COST_BOUNDS).T
    cost = -np.log((changed + 0.5) / (seen + 1) / (len(STATES) - 1))
    return Model(model.table, np.clip(cost, low, high).astype(np.float32))


def viterbi(codes: np.ndarray, cost: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Most likely column of ``table`` for every character of a batch: rows are sequences, padded with the last row of the table."""
    n, longest = codes.shape
    width = table.shape[1]
    rows = np.arange(n)
    score = table[codes[:, 0]].copy()
    stay, best = np.empty((longest, n, width), bool), np.empty((longest, n), np.int8)
    for t in range(1, longest):
        m = score.argmax(1)
        change = (score[rows, m] - cost[:, t])[:, None]
        np.greater_equal(score, change, out=stay[t])
        best[t] = m
        np.maximum(score, change, out=score)
        score += table[codes[:, t]]
    path = np.empty((n, longest), np.int8)
    s = score.argmax(1)
    for t in range(longest - 1, -1, -1):
        path[:, t] = s
        if t:
            s = np.where(stay[t, rows, s], s, best[t])
    return path


def _decoded(seqs: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, states, number of the sequence) of all characters of the sequences, in one array; two line ends stand before each."""
    u = _points("\n\n" + "\n\n".join(seqs))
    size = np.fromiter(map(len, seqs), np.int64, len(seqs))
    begin = np.cumsum(size + 2) - size
    codes, cost, state = _codes(u), model.cost[_places(u)], np.zeros(len(u), np.int8)
    script = np.concatenate([[0], np.cumsum(_SCRIPT[u] > 0)])
    foreign = script[begin + size] > script[begin]
    order = np.lexsort((size, foreign))
    latin = np.ascontiguousarray(model.table[:, _LATIN])
    sizes, kinds, at = size[order], foreign[order], 0
    while at < len(order):
        # of about equal length and one kind, and no more than fit the caches
        end = min(np.searchsorted(sizes[at:] if kinds[at] else sizes[at : len(order) - kinds.sum()], 1.2 * sizes[at] + 8, "right") + at, at + 1 + int(200_000 // max(1, sizes[at])))
        group = order[at:end]
        longest = int(sizes[end - 1])
        where = begin[group][:, None] + np.arange(longest)
        inside = np.arange(longest) < size[group][:, None]
        where = np.where(inside, where, 0)
        path = viterbi(np.where(inside, codes[where], len(model.table) - 1), np.where(inside, cost[where], 0), model.table if kinds[at] else latin)
        state[where[inside]] = (path if kinds[at] else _LATIN[path])[inside]
        at = end
    return u, state, np.repeat(np.arange(len(seqs)), size + 2)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(number of the text, sequence) of all texts, in groups of bounded size."""
    owner, seqs, held = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(observed(plain_lines(t))) if t else ():
            owner.append(i)
            seqs.append(p)
            held += len(p)
            if held > GROUP:
                yield owner, seqs
                owner, seqs, held = [], [], 0
    if seqs:
        yield owner, seqs


def spans(texts: list[str | None], model: Model) -> list[dict[str, tuple[int, int, int]]]:
    """For each text {language: (words, Chinese or Japanese characters, characters)} of the spans outside code.

    A word belongs to the state of its middle. Marks of identifiers are no characters of a span.
    """
    states = len(STATES)
    words, cjk, chars = (np.zeros(len(texts) * states, np.int64) for _ in range(3))
    for owner, seqs in _groups(texts):
        u, state, seq = _decoded(seqs, model)
        cell = np.array(owner)[seq] * states + state
        letter = _LETTER[u]
        joined = letter.copy()
        joined[1:-1] |= np.isin(u[1:-1], (39, 0x2019, 45)) & letter[:-2] & letter[2:]
        edge = np.diff(joined.astype(np.int8), append=0)
        first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1)  # a line end stands before the first
        words += np.bincount(cell[(first + last) // 2], minlength=len(words))
        cjk += np.bincount(cell[(_SCRIPT[u] == 2) & (_HA[u] != 3)], minlength=len(words))
        chars += np.bincount(cell[(u > 2) & (state > 0)], minlength=len(words))
    words, cjk, chars = (x.reshape(-1, states) for x in (words, cjk, chars))
    out: list[dict[str, tuple[int, int, int]]] = [{} for _ in texts]
    for i, k in zip(*(x.tolist() for x in np.nonzero(chars)), strict=True):
        if k not in (0, _OTHER):
            asian = k in (_ZH, _JA)
            out[i][STATES[k]] = (0 if asian else int(words[i, k]), int(cjk[i, k]) if asian else 0, int(chars[i, k]))
    return out


def sample_of(texts: DataFrame, text: str, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """The different texts among about ``rows`` rows of ``chars`` characters: those of smallest text hash, under a threshold from one count.

    What comes to the driver is bounded by the two parameters, not by the number of rows or tasks: the threshold is a share of the hash's
    range, equal texts come once, and a text that alone would take a hundredth of the characters is left out of the sample.
    """
    size = F.length(text)
    n, total = texts.agg(F.count(text), F.sum(F.least(size, F.lit(chars // 100)))).first()
    if not n:
        return []
    share = min(1.0, rows / n, chars / max(1, total or 0))
    low = F.shiftrightunsigned(F.xxhash64(text), 1) <= F.lit(min(int(share * 2.0**63), 2**63 - 1))
    return sorted(r[0] for r in texts.where(low & (size <= chars // 100)).select(text).distinct().collect())


def hidden_text(comments: DataFrame, keys: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(keys, nl_lang, words, chars, span): natural-language text of each row by language, outside code.

    Words of languages with spaces, Chinese and Japanese characters, and characters of the spans are counted; a span is never longer
    than its text. Rows without such text, null and blank ones among them, give nothing. Rows equal in keys and text count
    once. Other columns are ignored, whatever their names. Texts of any length are read whole. An empty table gives an
    empty result.

    Each comment is decoded as a whole, all its lines and literals in one sequence; where it is code is for the model to say.
    It is fitted on about ``sample`` rows (``sample_of``), first labelled by script, common words and sure signs of code; every row is then decoded
    with it in its task. No shuffle but the one that drops repeated rows.
    """
    ensure_importable(comments.sparkSession)
    rows = comments.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    table = comments.sparkSession.sparkContext.broadcast(fit(sample_of(rows, "__text", sample)))
    rows = rows.distinct()
    schema = ", ".join([*(f"`{k}` {comments.schema[k].dataType.simpleString()}" for k in keys), "nl_lang string, words long, chars long, span long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = spans(b["__text"].tolist(), table.value)
            out = b[keys].loc[b.index.repeat([len(g) for g in got])].reset_index(drop=True)
            flat = [(lang, *v) for g in got for lang, v in g.items()]
            for k, c in enumerate(("nl_lang", "words", "chars", "span")):
                out[c] = [f[k] for f in flat]
            yield out

    return rows.mapInPandas(run, schema)


def running_text() -> Column:
    """Rows of hidden_text with enough words, or characters, to be running text."""
    return (F.col("words") >= LEAST_WORDS) | (F.col("chars") >= LEAST_CHARS)
