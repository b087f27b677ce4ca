"""Results as table, JSON or CSV text. Rows come to the driver one partition at a time."""
from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row

FORMATS = ("table", "json", "csv")
MAX_CELL = 60


def validate_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f'unsupported format "{name}"')
    return name


def plain(v: object) -> object:
    """A value as JSON knows it: decimals as text, times as microseconds, maps as pairs, blobs as text."""
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        t = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return round(t.timestamp() * 1_000_000)
    if isinstance(v, dt.date):
        return (v - dt.date(1970, 1, 1)).days
    if isinstance(v, dt.timedelta):
        return f"0:{v.days}:{(v - dt.timedelta(days=v.days)) // dt.timedelta(microseconds=1) * 1000}"
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return [[plain(k), plain(x)] for k, x in v.items()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(bytes(v)) if isinstance(v, (bytes, bytearray)) else str(v)


def _text(v: object) -> str:
    if isinstance(v, float) and v != v or v in (float("inf"), float("-inf")):
        return "null"
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def rows_of(df: DataFrame) -> Iterator[list[object]]:
    return ([plain(v) for v in r] for r in df.toLocalIterator())


def json_lines(columns: list[str], rows: Iterable[list[object]]) -> Iterator[str]:
    """One line with an array of objects, keys sorted; of columns with one name the last counts."""
    yield "["
    for n, r in enumerate(rows):
        yield "," * (n > 0) + _text(dict(zip(columns, r, strict=True)))
    yield "]\n"


def csv_lines(columns: list[str], rows: Iterable[list[object]]) -> Iterator[str]:
    """The header as it is; texts are quoted if they hold a comma, a quote or a line end."""
    yield ",".join(columns) + "\n"
    for r in rows:
        yield ",".join('"' + v.replace('"', '""') + '"' if isinstance(v, str) and any(c in v for c in ',"\n') else _text(v) for v in r) + "\n"


def table_lines(columns: list[str], rows: Iterable[list[object]]) -> Iterator[str]:
    """Columns as wide as their longest cell, numbers to the right, long cells cut. All rows are needed for the widths."""
    if not columns:
        return
    rows = list(rows)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    cells = []
    for r in rows:
        texts = ["" if v is None else _text(v) for v in r]
        cells.append([t[: MAX_CELL - 3] + "..." if len(t) > MAX_CELL else t for t in texts])
    width = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    right = [any(number(r[i]) for r in rows) and all(r[i] is None or number(r[i]) for r in rows) for i in range(len(columns))]
    yield "  ".join(c.ljust(w) for c, w in zip(columns, width, strict=True)) + "\n"
    yield "  ".join("-" * w for w in width) + "\n"
    for r in cells:
        yield "  ".join(t.rjust(w) if a else t.ljust(w) for t, w, a in zip(r, width, right, strict=True)) + "\n"


def write_result(df: DataFrame, form: str, out: TextIO) -> None:
    lines = {"table": table_lines, "json": json_lines, "csv": csv_lines}[validate_format(form)]
    for x in lines(df.columns, rows_of(df)):
        out.write(x)
