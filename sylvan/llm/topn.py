"""Top N items within every group: a mergeable aggregation with a size-N bounded heap per group."""
from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import ensure_importable

#: A task hands its heaps on when it holds so many groups, so its memory is bounded; the merge puts them together.
MAX_GROUPS = 200_000


class BoundedHeap:
    """The best N entries (-score, identifier), identifiers distinct, best first; the last is the one to beat.

    Feeding and merging in any order gives the same N: an entry that was dropped is worse than N others for good,
    unless its identifier comes again with a better score, which then is compared anew.
    """

    __slots__ = ("n", "best")

    def __init__(self, n: int):
        self.n, self.best = n, []

    def add(self, entry: tuple) -> None:
        best = self.best
        if len(best) == self.n and entry >= best[-1]:
            return
        for k, old in enumerate(best):
            if old[1] == entry[1]:
                if entry[0] >= old[0]:
                    return
                del best[k]
                break
        insort(best, entry)
        del best[self.n :]


def _rows(b: pa.RecordBatch, group: str, score: str, ids: list[str]) -> Iterator[tuple]:
    """(group, -score, identifier) of every row."""
    worse = (-s for s in b.column(score).to_pylist())
    return zip(b.column(group).to_pylist(), worse, zip(*(b.column(c).to_pylist() for c in ids), strict=True), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _fill(group: str, score: str, ids: list[str], n: int, schema: pa.Schema):
    """Heaps of the groups in a partition, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}
        flush = lambda: _batch([(g, -s, *i) for g, h in heaps.items() for s, i in h.best], schema)
        for b in batches:
            for g, s, i in _rows(b, group, score, ids):
                h = heaps.get(g)
                if h is None:
                    h = heaps[g] = BoundedHeap(n)
                elif len(h.best) == n and s > h.best[-1][0]:
                    continue
                h.add((s, i))
            if len(heaps) > MAX_GROUPS:
                yield flush()
                heaps.clear()
        yield flush()

    return run


def _merge(group: str, score: str, ids: list[str], n: int, schema: pa.Schema):
    """Heaps of the same group put together, after the shuffle; rows come sorted by group, so one heap is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, BoundedHeap(n)
        close = lambda: [(now, k, -s, *i) for k, (s, i) in enumerate(heap.best, 1)]
        for b in batches:
            out: list[tuple] = []
            for g, s, i in _rows(b, group, score, ids):
                if g != now:
                    out += close()
                    now, heap = g, BoundedHeap(n)
                heap.add((s, i))
            yield _batch(out, schema)
        yield _batch(close(), schema)

    return run


def top_n(df: DataFrame, group: str, score: str, ids: list[str], n: int = 3, place: str = "place") -> DataFrame:
    """The ``n`` best rows of every ``group`` by ``score`` descending, then by ``ids`` ascending, with their ``place`` from 1.

    ``ids`` tell items apart inside a group; an item given more than once counts once, with its highest score. Rows with
    null in the group, the score or an id, or with a NaN score, do not count. Ties are broken by the ids, so the result is
    always the same. An empty table gives an empty result. Only the named columns are read; others may have any name. The group
    and the ids may be of any type that has an order.

    Heaps are filled before the shuffle, so a group with a third of all rows sends n rows from each task, not all of them;
    the heaps are merged after it.
    """
    ensure_importable(df.sparkSession)
    cols = [group, score, *ids]
    ok = ~F.isnan(score)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    src = df.where(ok).select(group, (F.col(score).cast("double") + F.lit(0.0)).alias(score), *ids)
    arrow = [(c, to_arrow_type(src.schema[c].dataType)) for c in cols]
    out = T.StructType([src.schema[group], T.StructField(place, T.LongType()), *[src.schema[c] for c in cols[1:]]])
    filled = src.mapInArrow(_fill(group, score, ids, n, pa.schema(arrow)), src.schema)
    merge = _merge(group, score, ids, n, pa.schema([arrow[0], (place, pa.int64()), *arrow[1:]]))
    return filled.repartition(group).sortWithinPartitions(group).mapInArrow(merge, out)
