"""Grouping records into similarity clusters by density peaks."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .topn import top_n

#: Width of a block on the bent scale; over 2, so that the reach of a point, 1 to either side, lies in two blocks at most.
CELL = 2.5


def near(a: Column, b: Column, step: int, percent: int) -> Column:
    """Two whole numbers differ by at most ``step`` or by at most ``percent`` of the larger one; exact in whole numbers."""
    d = F.abs(a - b)
    return (d <= step) | (d * 100 <= F.greatest(a, b) * percent)


def scale(x: Column, step: int, percent: int) -> Column:
    """A measure bent so that two near values lie at most 1 apart: even steps first, then logarithmic."""
    knee = max(1.0, math.floor(100 * step / percent))
    ratio = -math.log(1 - percent / 100)
    return F.when(x <= knee, x / F.lit(float(step))).otherwise(knee / step + F.log(x / knee) / ratio)


class DensityPeaks:
    """Density peaks over records described by non-negative whole measures.

    Records with the same measures form one point. Its local density is the number of records that hold it or, with
    ``density='radius'`` for measures so fine that few records agree, of those that hold it or a point near it. Neighbours
    are points near in every measure. Each point's gap is the distance to its nearest denser neighbour; one with no denser or
    equally dense neighbour has a gap beyond the radius. Peaks are points with such a gap whose neighbourhood holds at least
    ``share`` of all records. Every other point follows its pointer to the nearest denser neighbour until it comes to a
    peak, whose label it takes. Where the pointers end before one (a local top held by too few records), the pointer goes to the nearest
    peak at any distance; without any peak such a top is a centre itself. Equal densities are ordered by the measures, so the pointers
    have no cycle.

    Neighbours are joined in blocks: each bent measure is cut into cells wider than 2, a point is sent to the one or two
    cells that its neighbours can lie in, so at most 16 for four measures, and compared inside them only. The join runs
    twice: mass and gap come from an aggregation of plain numbers, which is hashed and never sorted; then only the pairs
    at just that gap give the pointers.

    Rows with a null or negative measure do not count; rows equal in ids and measures count once. An empty table has no
    peaks and no clusters. Other columns are ignored, whatever their names.
    """

    def __init__(self, records: DataFrame, ids: list[str], measures: list[str], step: int = 1, percent: int = 12, share: tuple[int, int] = (2, 100), density: str = "copies"):
        if density not in ("copies", "radius"):
            raise ValueError("density is 'copies' or 'radius'")
        self.ids, self.measures, self.step, self.percent, self.share = ids, measures, step, percent, share
        usable = reduce(lambda x, m: x & F.col(m).isNotNull() & (F.col(m) >= 0), measures, F.lit(True))
        self.records = cut(records.where(usable).select(*ids, *measures).distinct())
        self.bends = [f"__s{k}" for k in range(len(measures))]
        bent = {b: scale(F.col(m), step, percent) for b, m in zip(self.bends, measures, strict=True)}
        self.points = cut(self.records.groupBy(*measures).agg(F.count("*").alias("held")).withColumns({"density": F.col("held")} | bent))
        self.total = self.records.count()
        if density == "radius":
            around = self._neighbours().groupBy(*[F.col(f"a_{m}").alias(m) for m in measures]).agg(F.sum("b_held").alias("others"))
            self.points = cut(self.points.drop("density").join(around, measures, "left").select(*measures, "held", (F.col("held") + F.coalesce("others", F.lit(0))).alias("density"), *self.bends))
        self._shape: DataFrame | None = None
        self._peaks: DataFrame | None = None

    def _blocks(self, reach: bool) -> list[tuple[str, Column]]:
        """Cells of a point, or the cells that its neighbours can lie in."""
        out = []
        for k, s in enumerate(self.bends):
            lo, hi = F.floor((F.col(s) - 1 - 1e-9) / CELL), F.floor((F.col(s) + 1 + 1e-9) / CELL)
            out.append((f"__c{k}", F.explode(F.array_distinct(F.array(lo, hi))) if reach else F.floor(F.col(s) / CELL)))
        return out

    def _neighbours(self, points: DataFrame | None = None, centres: DataFrame | None = None) -> DataFrame:
        """(a_*, b_*): for every point a of ``points`` the points b near it but itself, b out of ``centres`` if given; all columns of both."""
        a, b = self.points if points is None else points, self.points if centres is None else centres
        cells = [k for k, _ in self._blocks(False)]
        b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], *[c.alias(k) for k, c in self._blocks(False)])
        names = a.columns
        for k, c in self._blocks(True):  # one generator at a time
            a = a.withColumn(k, c)
        a = a.select(*[F.col(c).alias(f"a_{c}") for c in names], *cells)
        close = reduce(lambda x, m: x & near(F.col(f"a_{m}"), F.col(f"b_{m}"), self.step, self.percent), self.measures, F.lit(True))
        other = reduce(lambda x, m: x | (F.col(f"a_{m}") != F.col(f"b_{m}")), self.measures, F.lit(False))
        return a.join(b if centres is None else F.broadcast(b), cells).where(close & other).drop(*cells)

    def _gap(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """Distance on the bent scale, rounded so that equal ones tie."""
        return F.round(F.sqrt(reduce(lambda x, y: x + y, [F.pow(a(s) - b(s), F.lit(2)) for s in self.bends])), 9)

    def _denser(self) -> Column:
        a, b = (F.struct(*[F.col(f"{side}_{m}").alias(m) for m in self.measures]) for side in "ab")
        return (F.col("b_density") > F.col("a_density")) | ((F.col("b_density") == F.col("a_density")) & (b < a))

    def shape(self) -> DataFrame:
        """Points with density, mass (records that hold them or a neighbour), top (largest density near), gap and ``up``, the nearest denser neighbour; null if there is none."""
        if self._shape is None:
            me, gap = [F.col(f"a_{m}").alias(m) for m in self.measures], self._gap(lambda s: F.col(f"a_{s}"), lambda s: F.col(f"b_{s}"))
            around = self._neighbours().groupBy(*me).agg(F.sum("b_held").alias("others"), F.max("b_density").alias("top"), F.min(F.when(self._denser(), gap)).alias("gap"))
            got = cut(self.points.join(around, self.measures, "left").withColumn("mass", F.col("held") + F.coalesce("others", F.lit(0))).drop("others"))
            at = F.struct((-F.col("b_density")).alias("d"), F.struct(*[F.col(f"b_{m}").alias(m) for m in self.measures]).alias("at"))
            up = self._neighbours(got.where("gap is not null")).where(self._denser() & (gap == F.col("a_gap"))).groupBy(*me).agg(F.min(at).alias("up"))
            self._shape = cut(got.join(up, self.measures, "left").withColumn("up", F.col("up.at")))
        return self._shape

    def peaks(self) -> DataFrame:
        """Measures, density and mass of the peaks: gap beyond the radius, and a neighbourhood that holds the share."""
        if self._peaks is None:
            part, whole = self.share
            held = (F.col("mass") * whole >= F.lit(self.total) * part) & F.col("gap").isNull() & F.coalesce(F.col("density") > F.col("top"), F.lit(True))
            self._peaks = cut(self.shape().where(held).select(*self.measures, "held", "density", "mass", *self.bends))
        return self._peaks.select(*self.measures, "density", "mass")

    def pointers(self) -> DataFrame:
        """(point, up): every point with the one it points to, peaks and centres with themselves.

        The peaks are broadcast: each holds ``share`` of all records with its neighbours, and a record is near few peaks,
        as they are not near each other (3 to the number of measures at most), so their number has a bound.
        """
        me = F.struct(*self.measures)
        self.peaks()
        chosen = self._peaks.select(me.alias("point")).withColumn("peak", F.lit(True))
        now = self.shape().select(me.alias("point"), "up", *self.bends).join(F.broadcast(chosen), "point", "left")
        goes = now.where("peak or up is not null").select("point", F.when(F.col("peak"), F.col("point")).otherwise(F.col("up")).alias("up"))
        tops = now.where("peak is null and up is null").select("point", *self.bends)
        # one row that holds all peaks: a top looks through a list of bounded length
        listed = self._peaks.agg(F.collect_list(F.struct((-F.col("density")).alias("d"), F.struct(*self.measures).alias("peak"), *self.bends)).alias("peaks"))
        gap = lambda p: self._gap(F.col, lambda s: p[s])
        nearest = F.array_min(F.transform("peaks", lambda p: F.struct(gap(p).alias("gap"), p["d"].alias("d"), p["peak"].alias("peak"))))
        return goes.unionByName(tops.crossJoin(F.broadcast(listed)).select("point", F.coalesce(nearest["peak"], "point").alias("up")))

    def labels(self) -> DataFrame:
        """Every point with ``label``, the struct of the measures of its peak. Pointers double in length each round."""
        now = cut(self.pointers().select("point", F.col("up").alias("label")))
        while True:
            nxt = now.select(F.col("point").alias("label"), F.col("label").alias("beyond"))
            step = cut(now.join(nxt, "label").select("point", F.col("beyond").alias("label"), (F.col("beyond") != F.col("label")).alias("moved")))
            now = step.select("point", "label")
            if step.where("moved").isEmpty():
                return now

    def clusters(self) -> DataFrame:
        """Every record with the measures of its cluster's centre, as ``centre_*``."""
        label = self.labels().select("point.*", *[F.col(f"label.{m}").alias(f"centre_{m}") for m in self.measures])
        return self.records.join(label, self.measures)

    def described(self, n: int = 3) -> DataFrame:
        """Of every cluster its centre, its size in records, and its ``n`` most typical combinations: those held by most records, ties by the measures; one row for each, with its ``place``."""
        label = cut(self.labels().select("point.*", *[F.col(f"label.{m}").alias(f"centre_{m}") for m in self.measures]).join(self.points, self.measures))
        centre = [f"centre_{m}" for m in self.measures]
        size = label.groupBy(*centre).agg(F.sum("held").alias("cluster_size"))
        best = top_n(label.withColumn("cluster", F.concat_ws(",", *centre)), "cluster", "held", [*self.measures, *centre], n)
        return best.join(size, centre).select(*centre, "cluster_size", "place", *self.measures, F.col("held").cast("long").alias("held"))

    def near_peaks(self) -> DataFrame:
        """Every record near a peak, or on it: ids and the peak's measures; a record near two peaks comes twice.

        A point's own peak is its label, checked to be near; the other peaks near it come from the join with the peaks.
        """
        own = self.labels().select(*[F.col(f"point.{m}").alias(f"a_{m}") for m in self.measures], *[F.col(f"label.{m}").alias(f"b_{m}") for m in self.measures])
        close = reduce(lambda x, m: x & near(F.col(f"a_{m}"), F.col(f"b_{m}"), self.step, self.percent), self.measures, F.lit(True))
        self.peaks()
        is_peak = self._peaks.select(*[F.col(m).alias(f"b_{m}") for m in self.measures])
        label = own.where(close).join(F.broadcast(is_peak), [f"b_{m}" for m in self.measures], "left_semi").select(*own.columns)
        more = self._neighbours(centres=self._peaks).select(*own.columns).join(own, own.columns, "left_anti")
        pairs = label.unionByName(more).select(*[F.col(f"a_{m}").alias(m) for m in self.measures], *[f"b_{m}" for m in self.measures])
        return self.records.join(pairs, self.measures).select(*self.ids, *[F.col(f"b_{m}").alias(m) for m in self.measures])
