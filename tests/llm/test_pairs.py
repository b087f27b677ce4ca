"""Components, top N, clusters and set joins against brute force."""
import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from conftest import rows
from sylvan.llm import components
from sylvan.llm.components import consolidate_pairs
from sylvan.llm.density import DensityPeaks
from sylvan.llm import setjoin
from sylvan.llm.setjoin import linked_records, overlap_needed, similar_set_pairs
from sylvan.llm.topn import BoundedHeap, top_n

PAIR = "fa string, na string, fb string, nb string, f string"


def groups(df, cell):
    return consolidate_pairs(df, ["fa", "na"], ["fb", "nb"], ["f", "n"], ["gf", "gn"], cell)


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sorted((*x, *min(y for y in parent if find(y) == find(x))) for x in parent)


@pytest.mark.parametrize("cell", [1_000_000, 40, 7])
def test_groups(spark, cell):
    rng = random.Random(cell)
    name = lambda: (f"f{rng.randrange(12)}", f"n{rng.randrange(12)}")
    pairs = [(name(), name()) for _ in range(90)] + [(("hub", "h"), (f"x{i}", "y")) for i in range(60)] + [((f"c{i}", ""), (f"c{i + 1}", "")) for i in range(50)] + [(("self", "s"), ("self", "s"))]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[:20]]
    df = spark.createDataFrame([(*a, *b, "clash") for a, b in pairs] + [(None, "n", "f", "n", "x"), ("f", "n", "f", None, "x")], PAIR)
    assert rows(groups(df, cell)) == brute_groups(pairs)


@pytest.mark.parametrize("ids", [5, 40])
def test_groups_with_shared_hashes(spark, monkeypatch, ids):
    """A hash with very few values, so that nearly all records share theirs."""
    monkeypatch.setattr(components, "plain_id", lambda *c: F.pmod(F.xxhash64(*c), F.lit(ids)))
    rng = random.Random(ids)
    name = lambda: (f"f{rng.randrange(5)}", f"n{rng.randrange(9)}")
    pairs = [(name(), name()) for _ in range(30)]
    df = spark.createDataFrame([(*a, *b, "clash") for a, b in pairs], PAIR)
    assert rows(groups(df, 10)) == brute_groups(pairs)


def test_groups_of_nothing(spark):
    assert groups(spark.createDataFrame([], PAIR), 10).collect() == []
    assert rows(groups(spark.createDataFrame([("a", "b", "a", "b", None)], PAIR), 10)) == [("a", "b", "a", "b")]


ITEM = "g string, score double, id long, note string, place string"


@pytest.mark.parametrize("n", [1, 3])
def test_top_n(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["a", "b", "hot", "hot", "hot"]), rng.choice([0.0, -0.0, 0.25, 0.5, 1.0]), rng.randrange(30), None, "x") for _ in range(400)]
    dirty = [(None, 1.0, 1, "", ""), ("a", None, 1, "", ""), ("a", float("nan"), 1, "", ""), ("a", 9.0, None, "", "")]
    df = spark.createDataFrame(data + dirty, ITEM).repartition(7)
    best = {}
    for g, s, i, *_ in data:
        best[g, i] = max(best.get((g, i), -1), s)
    want = []
    for g in {g for g, _ in best}:
        ranked = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        want += [(g, k, -s, i) for k, (s, i) in enumerate(ranked, 1)]
    assert rows(top_n(df, "g", "score", ["id"], n)) == sorted(want)
    assert top_n(df.limit(0), "g", "score", ["id"], n).collect() == []


def test_top_n_of_any_types(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE'2020-01-02', 1.5BD, TIMESTAMP_NTZ'2021-01-01 00:00:00', true), (DATE'2020-01-02', 2.5BD, TIMESTAMP_NTZ'2021-01-02 00:00:00', false), (DATE'2020-01-02', 2.5BD, TIMESTAMP_NTZ'2020-01-02 00:00:00', false) AS t(g, s, i, note)")
    assert [(r.place, r.s, r.i.year) for r in top_n(df, "g", "s", ["i"], 2).orderBy("place").collect()] == [(1, 2.5, 2020), (2, 2.5, 2021)]


def test_heaps_merge():
    rng = random.Random(2)
    entries = [(-rng.randrange(5), (rng.randrange(9),)) for _ in range(60)]
    whole, left, right = BoundedHeap(4), BoundedHeap(4), BoundedHeap(4)
    for k, e in enumerate(entries):
        whole.add(e)
        (left if k % 2 else right).add(e)
    for e in right.best:
        left.add(e)
    best = {}
    for s, i in entries:
        best[i] = min(best.get(i, 0), s)
    assert left.best == whole.best == sorted((s, i) for i, s in best.items())[:4]


def near(a, b):
    return all(abs(x - y) <= 1 or abs(x - y) * 100 <= max(x, y) * 12 for x, y in zip(a, b))


def test_density_peaks(spark):
    rng = random.Random(4)
    prints = []
    for k in range(400):
        c = rng.choice([(3, 1, 5, 20), (3, 1, 5, 20), (40, 2, 30, 200), (0, 0, 0, 9)])
        p = tuple(max(0, x + rng.choice([0, 0, 0, 1, -1, int(x * 0.12)])) for x in c)
        prints.append((k, *p))
    prints += prints[:15]
    dirty = [(900, None, 1, 1, 1), (901, -1, 1, 1, 1)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(prints + dirty, "id long, a long, b long, c long, d long").selectExpr("*", "'x' as density", "1 as mass", "2 as up")
    d = DensityPeaks(df, ["id"], names)
    unique = set(prints)
    n = Counter(p[1:] for p in unique)
    peaks = [p for p in n if all(n[q] < n[p] for q in n if q != p and near(p, q)) and sum(n[q] for q in n if near(p, q)) * 100 >= 2 * len(unique)]
    assert sorted(tuple(r)[:4] for r in d.peaks().collect()) == sorted(peaks)
    assert rows(d.near_peaks()) == sorted((u[0], *p) for u in unique for p in peaks if near(u[1:], p))
    assert {tuple(r.point): tuple(r.label) for r in d.labels().collect()} == brute_labels(n, peaks)
    assert d.clusters().count() == len(unique)
    got = [tuple(r) for r in d.described(2).collect()]
    want = []
    label = brute_labels(n, peaks)
    for c in set(label.values()):
        mine = sorted((-n[p], p) for p in n if label[p] == c)
        want += [(*c, -sum(k for k, _ in mine), place, *p, -k) for place, (k, p) in enumerate(mine[:2], 1)]
    assert sorted(got) == sorted(want)


def brute_labels(density, peaks):
    """Follow the nearest denser neighbour to a peak; a top that is none goes to the nearest peak."""
    bend = lambda v: v if v <= 8 else 8 + math.log(v / 8) / -math.log(0.88)
    gap = lambda p, q: round(math.dist([bend(x) for x in p], [bend(x) for x in q]), 9)

    def follow(p):
        while p not in peaks:
            denser = [q for q in density if q != p and near(p, q) and (density[q] > density[p] or (density[q] == density[p] and q < p))]
            if not denser and not peaks:
                return p
            p = min((gap(p, q), -density[q], q) for q in denser or peaks)[2]
        return p

    return {p: follow(p) for p in density}


def test_density_within_the_radius(spark):
    """Measures so fine that no two records agree: density is the number of records near a point."""
    rng = random.Random(14)
    prints = [(k, 1000 * c + rng.randrange(90), rng.randrange(3)) for k, c in enumerate(rng.choices((1, 1, 1, 5, 40), k=80))]
    d = DensityPeaks(spark.createDataFrame(prints, "id long, a long, b long"), ["id"], ["a", "b"], density="radius")
    n = Counter(p[1:] for p in prints)
    mass = {p: sum(n[q] for q in n if near(p, q)) for p in n}
    peaks = [p for p in n if all(mass[q] < mass[p] for q in n if q != p and near(p, q)) and mass[p] * 100 >= 2 * len(prints)]
    assert sorted(tuple(r)[:2] for r in d.peaks().collect()) == sorted(peaks)
    assert {tuple(r.point): tuple(r.label) for r in d.labels().collect()} == brute_labels(mass, peaks)
    assert len(set(brute_labels(mass, peaks).values())) >= 3


def test_density_of_nothing(spark):
    d = DensityPeaks(spark.createDataFrame([], "id long, a long, b long"), ["id"], ["a", "b"])
    assert d.peaks().collect() == [] and d.near_peaks().collect() == [] and d.clusters().collect() == [] and d.described().collect() == []


SET = "f string, n string, w string, items string"


def brute_pairs(data, least):
    sets = {}
    for f, n, w in data:
        if n is not None and f is not None and w:
            sets.setdefault((f, n), set()).add(w)
    big = sorted(k for k, v in sets.items() if len(v) >= least)
    return [(*a, *b) for i, a in enumerate(big) for b in big[i + 1 :] if len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 7]


@pytest.mark.parametrize("small, split", [(3, 20_000), (6, 2), (8, 20_000)])
def test_set_pairs(spark, monkeypatch, small, split):
    monkeypatch.setattr(setjoin, "LIST", split)
    monkeypatch.setattr(setjoin, "COPIES", split)
    rng = random.Random(small)
    data = []
    for k in range(90):
        base = rng.choice([range(5), range(3, 12), range(20, 36), range(40, 65), range(6)])
        items = [w for w in base if rng.random() > 0.08] + ["hot"]
        data += [(f"f{k % 7}", f"n{k}", str(w)) for w in items]
        if k % 9 == 0:  # a copy of the set
            data += [("copy", f"n{k}", str(w)) for w in items]
    data += data[:30] + [("f", None, "x"), (None, "n", "x"), ("f", "n", None), ("f", "n", "")]
    df = spark.createDataFrame([(*d, "z") for d in data], SET)
    got = similar_set_pairs(df, ["f", "n"], "w", small=small)
    want = brute_pairs(data, 4)
    assert rows(got) == sorted(want) and got.columns == ["f_a", "n_a", "f_b", "n_b"]
    links = Counter([p[:2] for p in want] + [p[2:] for p in want])
    sets = {}
    for f, n, w in data:
        if f and n and w:
            sets.setdefault((f, n), set()).add(w)
    sets = {k: v for k, v in sets.items() if len(v) >= 4}
    assert rows(linked_records(df, ["f", "n"], "w", small=small)) == sorted((*k, *min(j for j in sets if sets[j] == v), links[k]) for k, v in sets.items())


def test_set_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], SET)
    assert similar_set_pairs(empty, ["f", "n"], "w").collect() == [] == linked_records(empty, ["f", "n"], "w").collect()


def test_overlap_needed():
    for s in range(1, 30):
        for t in range(1, 30):
            c = overlap_needed(s, t, 7, 10)
            ok = [o for o in range(min(s, t) + 1) if o * 10 >= (s + t - o) * 7]
            assert (ok[0] if ok else None) == (c if c <= min(s, t) else None)
