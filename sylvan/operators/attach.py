"""Forward as-of join: to every point the nearest target that follows it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def _known(columns: list[str]) -> Column:
    return reduce(lambda x, c: x & F.col(c).isNotNull(), columns, F.lit(True))


def following(points: DataFrame, targets: DataFrame, by: list[str], on: str, payload: list[str], width: int | None = 8192, out: str = "following") -> DataFrame:
    """(by, on, out) for every distinct place (by, on) of ``points`` that a row of ``targets`` follows; see attach_following.

    Both sides are reduced to one row a place before the shuffle, so a group's stretch of ``width`` values holds at most twice
    as many rows, whatever the number of points and targets in it. One pass over the stretch, sorted descending, so the
    frame only grows; no pair of rows is ever formed. What lies beyond a stretch comes from one row for each stretch. With
    ``width`` None a group is one stretch: for ``on`` that has a bound by itself, such as the lines of a file.
    """
    kind = T.StructType([T.StructField(on, T.LongType()), *[T.StructField(p, targets.schema[p].dataType) for p in payload]])
    bucket = (F.lit(0).cast("long") if width is None else F.floor(F.col(on) / width)).alias("__b")
    at = targets.where(_known([*by, on])).select(*by, on, bucket, F.struct(F.col(on), *payload).cast(kind).alias("__t"))
    places = points.where(_known([*by, on])).select(*by, on, bucket, F.lit(None).cast(kind).alias("__t"))
    both = places.withColumn("__p", F.lit(True)).unionByName(at.withColumn("__p", F.lit(False)))
    both = both.groupBy(*by, "__b", on).agg(F.min("__t").alias("__t"), F.max("__p").alias("__p"))
    later = W.partitionBy(*by, "__b").orderBy(F.col(on).desc())
    both = both.withColumn("__n", F.min("__t").over(later.rowsBetween(W.unboundedPreceding, -1))).withColumn("__f", F.min("__t").over(later.rowsBetween(W.unboundedPreceding, W.currentRow)))
    if width is None:
        return both.where("__p").select(*by, on, F.col("__n").alias(out)).where(F.col(out).isNotNull())
    # one row a stretch: its first target, which stands in the row of its smallest place, then those of all stretches behind it
    # (asking for __p keeps the columns below the window as they are above, so that both branches share one shuffle)
    first = both.groupBy(*by, "__b").agg(F.min("__f").alias("__f"), F.max("__p").alias("__p")).where("__p is not null").drop("__p")
    behind = W.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    beyond = first.withColumn("__m", F.min("__f").over(behind)).where("__m is not null").select(*by, "__b", "__m")
    return both.where("__p").join(beyond, [*by, "__b"], "left").select(*by, on, F.coalesce("__n", "__m").alias(out)).where(F.col(out).isNotNull())


def attach_following(points: DataFrame, targets: DataFrame, by: list[str], on: str, payload: list[str], width: int | None = 8192, out: str = "following") -> DataFrame:
    """``points`` with a struct ``out`` of (on, *payload) of the nearest row of ``targets`` with equal ``by`` and a strictly larger ``on``; null if none.

    ``on`` is a bigint. Targets that tie on ``on`` are ordered by ``payload``, nulls first. A null in ``by`` or ``on`` equals
    nothing: such points get null, such targets are found by none. Repeated points stay. All columns of ``points`` are kept;
    names starting with ``__`` are reserved. An empty side gives no points, or points with null.

    Points join the answer of their place (see ``following``), which is one row, so rows never multiply and a place that
    very many points share can be split between tasks by adaptive execution. Points with a null go round the join.
    """
    found = following(points, targets, by, on, payload, width, "__a")
    keys = [*by, on]
    places = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__a").alias("__a"))
    same = reduce(lambda x, i: x & (F.col(f"`{keys[i]}`") == F.col(f"__k{i}")), range(len(keys)), F.lit(True))
    kept = [F.col(f"`{c}`") for c in points.columns if c != out]
    whole = points.where(_known(keys)).join(places, same, "left").select(*kept, F.col("__a").alias(out))
    lost = points.where(~_known(keys)).select(*kept, F.lit(None).cast(found.schema["__a"].dataType).alias(out))
    return whole.unionByName(lost)


def attach_comments(comments: DataFrame, functions: DataFrame, structs: DataFrame) -> DataFrame:
    """Comments with ``attached_to``: name of the nearest function or struct below in the same file, '' if none; a function wins a tie.

    A window holds two rows for each line of a file at most, however many trees have a file of that path.
    """
    defs = functions.select("file", "line", F.lit(0).alias("__kind"), "name").unionByName(structs.select("file", "line", F.lit(1).alias("__kind"), "name"))
    got = attach_following(comments.drop("attached_to"), defs, ["file"], "line", ["__kind", "name"], None)
    name: Column = F.coalesce("following.name", F.lit(""))
    return got.select(*[name.alias(c) if c == "attached_to" else F.col(c) for c in comments.columns])
