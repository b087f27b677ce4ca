"""Rows of one file, and the one wide row that all tables share on their way out of a task."""
from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...schema import EXTRACTED, SCHEMAS

_LETTER = {T.StringType(): "s", T.LongType(): "n", T.BooleanType(): "b"}


def _slots(table: str) -> dict[str, str]:
    """Column of a table to the wide row's column that carries it."""
    seen: dict[str, int] = {}
    out = {"file": "file", "line": "line"}
    for f in SCHEMAS[table].fields[2:]:
        k = _LETTER[f.dataType]
        seen[k] = seen.get(k, 0) + 1
        out[f.name] = f"{k}{seen[k]}"
    return out


SLOTS = {t: _slots(t) for t in EXTRACTED}
_TYPE = {"s": T.StringType(), "n": T.LongType(), "b": T.BooleanType()}
_WIDE = sorted({s for slots in SLOTS.values() for s in slots.values()} - {"file", "line"})
WIDE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.LongType()), *[T.StructField(w, _TYPE[w[0]]) for w in _WIDE]])

_WIDTH = len(WIDE.fields)
#: Places in the wide row of a table's columns, from the line on.
PLACES = {t: [WIDE.names.index(s) for s in list(slots.values())[1:]] for t, slots in SLOTS.items()}


class Rows:
    """Rows of one file by table, as tuples in the order of the table's columns, without the file."""

    def __init__(self, file: str):
        self.file = file
        self.tables: dict[str, list[list]] = {t: [] for t in EXTRACTED}

    def add(self, table: str, *values: object) -> list:
        self.tables[table].append(row := list(values))
        return row

    def wide(self, wanted: Collection[str] = EXTRACTED) -> Iterator[tuple]:
        """Rows of the wanted tables as tuples in the order of WIDE."""
        for table, rows in self.tables.items():
            if table not in wanted:
                continue
            places = PLACES[table]
            for r in rows:
                row: list[object] = [None] * _WIDTH
                row[0], row[1] = table, self.file
                for p, v in zip(places, r, strict=True):
                    row[p] = v
                yield tuple(row)


def narrow(wide: DataFrame, table: str) -> DataFrame:
    """One table out of the wide rows."""
    cols: list[Column] = [F.col(slot).alias(name) for name, slot in SLOTS[table].items()]
    return wide.where(F.col("kind") == table).select(*cols)
