"""Several values packed in one field: a parsing expression grammar, run over Arrow batches.

Grammar (ordered choice, first alternative that matches wins; a failing one backtracks)::

    field   <- whole / list
    whole   <- space open list close space EOF      # brackets round the whole list only
    list    <- value? (delim value?)*
    value   <- piece+                               # trimmed
    piece   <- quoted / section / bracketed / char
    quoted  <- q (!q . / q q)* q &(space (delim / close / EOF))   # only at the start of a value
    section <- q (!q . / q q)* q !letter                          # quotes inside a value, which keeps them; not behind a letter
    bracketed <- open (quoted-inside / bracketed / !close .)* close
    delim   <- [,;|/&+\\t\\n\\r] / space 'and' space
    char    <- !delim .

A quote that never closes, or closes in the middle of a word, makes ``quoted`` and ``section`` fail; the grammar
then backtracks, takes the quote as an ordinary character and sets ``bad_quote``. A bracket without its
partner is taken as a character likewise and sets ``bad_bracket``.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ensure_importable

#: Delimiters, quotes and bracket pairs of the packed fields.
DELIMITERS = ",;|/&+\t\n\r"
WORD_DELIMITERS = ("and",)
QUOTES = "\"'`"
BRACKETS = {"<": ">", "(": ")", "[": "]", "{": "}"}
BAD_QUOTE, BAD_BRACKET = "bad_quote", "bad_bracket"


class _Peg:
    """One field being parsed. Every rule takes a position and returns the position behind its match, or -1."""

    def __init__(self, text: str, end: int | None = None, start: int = 0):
        self.s, self.end, self.start = text, len(text) if end is None else end, start
        self.flags: set[str] = set()
        self.partners: dict[int, int] | None = None

    def delim(self, i: int) -> int:
        s = self.s
        if s[i] in DELIMITERS:
            return i + 1
        if s[i].isspace():
            for w in WORD_DELIMITERS:
                j = i + 1
                while j < self.end and s[j] in " \xa0":
                    j += 1
                k = j + len(w)
                if k < self.end and s.startswith(w, j) and s[k].isspace():
                    return k
        return -1

    def space(self, i: int) -> int:
        while i < self.end and self.s[i].isspace() and self.s[i] not in DELIMITERS:
            i += 1
        return i

    def quoted(self, i: int, whole: bool = True) -> int:
        """A value in quotes, or with ``whole`` off a section of one; a doubled quote inside stands for one."""
        q, j = self.s[i], i + 1
        while True:
            j = self.s.find(q, j, self.end)
            if j < 0:
                return -2  # no quote of this kind closes any more
            if self.s.startswith(q, j + 1, self.end):
                j += 2
                continue
            k = self.space(j + 1)
            if k >= self.end or self.delim(k) > 0 or self.delim(j + 1) > 0:
                return j + 1
            return -1 if whole or self.s[j + 1].isalnum() else j + 1

    def bracketed(self, i: int) -> int:
        """Behind the partner of the bracket at ``i``, or -1. All partners are found in one pass and remembered."""
        if self.partners is None:
            s, stack, open_, self.partners, lone, j = self.s, [], dict.fromkeys(BRACKETS.values(), 0), {}, set(), self.start
            while j < self.end:
                c = s[j]
                if c in BRACKETS:
                    stack.append((BRACKETS[c], j))
                    open_[BRACKETS[c]] += 1
                elif open_.get(c):
                    while True:  # those without a partner above it fail
                        close, at = stack.pop()
                        open_[close] -= 1
                        if close == c:
                            break
                    self.partners[at] = j + 1
                elif c in QUOTES and c not in lone and not (j and s[j - 1].isalnum()):
                    k = s.find(c, j + 1, self.end)
                    if k < 0:
                        lone.add(c)
                    elif not s[k + 1 : k + 2].isalnum():
                        j = k
                j += 1
        return self.partners.get(i, -1)

    def whole(self) -> _Peg | None:
        """The list inside brackets that enclose everything."""
        i, j = self.start, self.end
        while i < j and self.s[i].isspace():
            i += 1
        while j > i and self.s[j - 1].isspace():
            j -= 1
        if i < j and self.s[i] in BRACKETS and self.bracketed(i) == j:
            return _Peg(self.s, j - 1, i + 1)
        return None

    def values(self) -> list[str]:
        out, i, begin, lone = [], self.start, self.start, set()
        quoted_to = -1

        def emit(stop: int) -> None:
            raw = self.s[begin:stop].strip()
            if quoted_to >= 0:
                q = raw[:1]
                raw = raw[1:-1].replace(q + q, q).strip()
            if raw:
                out.append(raw)

        fresh = True
        while i < self.end:
            c = self.s[i]
            j = self.delim(i)
            if j > 0:
                emit(i)
                # the white space that closes a word delimiter also opens the next value
                i = begin = j
                quoted_to, fresh = -1, True
                continue
            if fresh and c.isspace():
                i += 1
                continue
            if c in QUOTES and c not in lone and (fresh or not self.s[i - 1].isalnum()):
                j = self.quoted(i) if fresh else -1
                if j > 0:
                    i = quoted_to = j
                    fresh = False
                    continue
                j = self.quoted(i, whole=False)
                if j > 0:
                    i, fresh = j, False
                    continue
                self.flags.add(BAD_QUOTE)
                if j == -2:
                    lone.add(c)
            elif c in BRACKETS:
                j = self.bracketed(i)
                if j > 0:
                    i, fresh = j, False
                    continue
                self.flags.add(BAD_BRACKET)
            fresh = False
            i += 1
        emit(self.end)
        return out


@lru_cache(maxsize=20_000)
def parse_packed(text: str | None) -> tuple[tuple[str, ...], str]:
    """Values of one field in order, and its error flags joined by a comma ('' if none)."""
    if not text:
        return (), ""
    outer = _Peg(text)
    inner = outer.whole()
    p = inner or outer
    values = p.values()
    return tuple(values), ",".join(sorted(p.flags))


def explode_packed(df: DataFrame, value: str, keep: list[str], pos: str = "pos", item: str = "item", flags: str = "flags") -> DataFrame:
    """One row per value packed in ``value``: the ``keep`` columns, position from 1, the value and the field's error flags.

    Null, blank and delimiter-only fields give no row. Empty values take no position. Repeated values stay.
    Repeated input rows give repeated output rows. Extra columns are dropped; the output holds ``keep`` + the
    three new columns only, so other columns may have any name. Texts of any length are parsed whole.
    """
    ensure_importable(df.sparkSession)
    src = df.select(*[F.col(c) for c in keep], F.col(value).cast("string").alias("__packed")).where(F.col("__packed").isNotNull())
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(pos, T.LongType()), T.StructField(item, T.StringType()), T.StructField(flags, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_packed(x) for x in b["__packed"]]
            n = [len(v) for v, _ in parsed]
            out = b[keep].loc[b.index.repeat(n)].reset_index(drop=True)
            out[pos] = [k for c in n for k in range(1, c + 1)]
            out[item] = [x for v, _ in parsed for x in v]
            out[flags] = [f for v, f in parsed for _ in v]
            yield out

    return src.mapInPandas(run, schema)
