"""Consolidating pairwise matches into groups: union-find on a two-dimensional grid of edge blocks."""
from __future__ import annotations

import math
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ensure_importable

#: The grid has at most so many rows, which bounds the table of cell sizes that is broadcast.
MAX_BLOCKS = 512
_STAR = "v long, root long"


def _local_union(cell: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the edges of one cell; every vertex of the cell with its smallest reachable vertex."""
    names, ends = np.unique(cell[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    parent = list(range(len(names)))
    for x, y in zip(ends[:, 0].tolist(), ends[:, 1].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for v in range(len(parent)):  # a parent is never larger than its child, so its own root is known by now
        parent[v] = parent[parent[v]]
    return pd.DataFrame({"v": names, "root": names[parent]})


def grid_blocks(n: int, cell_edges: int) -> int:
    """Blocks the vertices are hashed into, so that an average cell of the half grid has about ``cell_edges`` edges."""
    return 1 if n <= cell_edges else min(MAX_BLOCKS, math.ceil(math.sqrt(2 * n / cell_edges)))


def _round(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    """Local union-find on every cell of the grid: rows (v, root), one for each cell that holds v."""
    blocks = grid_blocks(n, cell_edges)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    ba, bb = block("a"), block("b")
    grid = edges.select("a", "b", F.least(ba, bb).alias("row"), F.greatest(ba, bb).alias("col"))
    if blocks == 1:
        return grid.groupBy("row", "col").applyInPandas(_local_union, _STAR)
    # a cell with more edges than fit, as with a vertex that holds a third of them, is cut into parts; any part of the edges may be united on its own
    parts = grid.groupBy("row", "col").count().select("row", "col", F.ceil(F.col("count") / cell_edges).alias("parts"))
    grid = grid.join(F.broadcast(parts), ["row", "col"]).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
    return grid.groupBy("row", "col", "part").applyInPandas(_local_union, _STAR)


def connected_labels(edges: DataFrame, cell_edges: int = 250_000) -> DataFrame:
    """(v, label) for the vertices of ``edges`` (columns a, b: bigint, a != b, no nulls); label is the smallest v of the component.

    Each round hashes the vertices into blocks, unites the edges of every block pair on their own, then exchanges the
    representatives along rows and columns: a vertex takes the smallest of its cells' representatives, and the others
    become edges to that one. Vertices that represent nobody drop out, so the graph shrinks by a constant factor a round,
    until no edge is left. Parents of all rounds are then followed from the last round back to the first.
    """
    parents: list[DataFrame] = []
    ensure_importable(edges.sparkSession)
    edges = cut(edges)
    while n := edges.count():
        stars = _round(edges, n, cell_edges)
        # a vertex lies in at most one row and one column of cells, so its set of representatives is bounded by the grid
        seen = cut(stars.groupBy("v").agg(F.min("root").alias("p"), F.collect_set("root").alias("roots")))
        parents.append(seen.select("v", "p"))
        if grid_blocks(n, cell_edges) == 1:
            break
        rest = seen.select("p", F.explode(F.expr("filter(roots, r -> r <> p)")).alias("r"))
        edges = cut(rest.select(F.col("p").alias("a"), F.col("r").alias("b")).distinct())
    if not parents:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = parents[-1].select("v", F.col("p").alias("label"))
    for up in reversed(parents[:-1]):
        nxt = labels.select(F.col("v").alias("p"), F.col("label").alias("next"))
        labels = up.join(nxt, "p", "left").select("v", F.coalesce("next", "p").alias("label"))
    return labels


def consolidate_pairs(pairs: DataFrame, left: list[str], right: list[str], key: list[str], group: list[str], cell_edges: int = 250_000) -> DataFrame:
    """One row per record named in ``pairs``: its ``key`` columns and, as ``group`` columns, the smallest record of its group.

    ``left`` and ``right`` name the columns that hold the two records; a row with a null in any of them links nothing and
    names nobody. Repeated and reversed pairs count once; a record paired only with itself is its own group. Records
    compare column by column. An empty table gives an empty result. Other columns are ignored, whatever their names.
    Records are identified inside by a 64-bit hash; those few that share one are found and get another, see ``identified``.
    """
    ok = F.lit(True)
    for c in [*left, *right]:
        ok = ok & F.col(c).isNotNull()
    rows = pairs.where(ok)
    records, again = identified(rows, left, right, key)
    a, b = plain_id(*left), plain_id(*right)
    if again is not None:
        for cols, name in ((left, "__a"), (right, "__b")):
            new = again.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("h").alias(name))
            rows = rows.join(new, reduce(lambda x, y: x & y, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(cols)]), "left").drop(*[f"__k{i}" for i in range(len(key))])
        a, b = F.coalesce("__a", a), F.coalesce("__b", b)
    edges = rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()  # a pair given very often is one edge
    labels = connected_labels(edges, cell_edges)
    found = records.join(labels, F.col("h") == F.col("v"), "left").select(*key, F.coalesce("label", "h").alias("label"))
    best = found.groupBy("label").agg(F.min(F.struct(*key)).alias("first"))
    return found.join(best, "label").select(*key, *[F.col(f"first.{k}").alias(g) for k, g in zip(key, group, strict=True)])


def plain_id(*columns: str) -> Column:
    """Id of a record by its columns, unless another record has the same."""
    return F.xxhash64(*columns)


def identified(rows: DataFrame, left: list[str], right: list[str], key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(records, again): every record once with its 64-bit id ``h``, no two alike; ``again`` holds the records whose id is not their plain hash, or is None.

    The expected number of records that share a hash is n^2 / 2^64: none for a billion, a few for ten billions, 540 for
    10^11. Only these are hashed anew, with another seed until all are told apart, so nothing is drawn again for the rest.
    """
    ends = F.array(*(F.struct(*[F.col(c).alias(k) for c, k in zip(cols, key, strict=True)]) for cols in (left, right)))
    records = cut(rows.select(F.explode(ends).alias("e")).select("e.*").distinct().withColumn("h", plain_id(*key)))
    shared = cut(records.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return records, None
    sole = records.join(shared, "h", "left_anti")
    twins = cut(records.join(shared, "h", "left_semi").select(*key))
    for seed in count(1):
        again = cut(twins.withColumn("h", F.xxhash64(F.lit(seed), *key)))
        if again.groupBy("h").count().where("count > 1").isEmpty() and sole.join(again, "h", "left_semi").isEmpty():
            return sole.select(*key, "h").unionByName(again), again
