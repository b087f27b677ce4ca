"""All similar pairs between set-valued records: size-aware overlap join."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ensure_importable, store


def overlap_needed(s: int, t: int, num: int, den: int) -> int:
    """Smallest overlap with which sets of s and t items share num/den of their union: o / (s + t - o) >= num / den."""
    return -(-num * (s + t) // (num + den))


def _subsets(small: int, least: int, num: int, den: int):
    """Threshold-sized subsets of the small sets: one row for each pair of sizes and subset, with the side of the pair that the set can be."""
    plans: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for s in range(least, small + 1):
        for t in range(least, small + 1):
            c = overlap_needed(s, t, num, den)
            if c <= min(s, t):
                plans.setdefault(s, []).append((min(s, t), max(s, t), np.array(list(combinations(range(s), c)))))
    mix = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["n"].to_numpy()
            for s in np.unique(sizes):
                part = b[sizes == s]
                h = np.stack(part["hashes"].to_list()).astype(np.int64).view(np.uint64)  # in one order everywhere
                for lo, hi, pick in plans.get(int(s), []):
                    key = np.full((len(part), len(pick)), np.uint64(int(mix) * (64 * lo + hi) % 2**64), dtype=np.uint64)
                    for k in range(pick.shape[1]):
                        key = (key ^ h[:, pick[:, k]]) * mix
                        key ^= key >> np.uint64(29)
                    side = LEFT * (s == lo) + RIGHT * (s == hi)
                    yield pd.DataFrame({"no": np.repeat(part["no"].to_numpy(), len(pick)), "n": np.int32(s), "side": np.int32(side), "key": key.ravel().view(np.int64)})

    return run


LEFT, RIGHT = 1, 2
#: Rows of one inverted list, and copies of one set, that a task takes; longer ones are split.
LIST, COPIES = 20_000, 4096


def set_classes(df: DataFrame, key: list[str], item: str, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records (``key``, number ``no`` of their class) and classes of equal sets (no, items, n, copies) with at least ``least`` items.

    ``df`` has one row per record and item. Rows with a null in ``key`` or a null or empty item are dropped; repeated rows
    count once. Sets are collected in part before the shuffle, as 64-bit hashes of the items, so no text of an item is ever
    shuffled and a record with very many repeated rows sends few. Two items of a pair of sets share a hash with a chance
    of 2^-64, which is the only way in which a result can differ from the texts'. One record's distinct items must fit a row.
    """
    ensure_importable(df.sparkSession)
    ok = F.col(item).isNotNull() & (F.col(item) != "")
    for k in key:
        ok = ok & F.col(k).isNotNull()
    sets = df.where(ok).select(*key, F.xxhash64(item).alias("__item")).groupBy(*key).agg(F.array_sort(F.collect_set("__item")).alias("items")).where(F.size("items") >= least)
    whole = store(sets.select(*key, "items", F.unhex(F.md5(F.array_join(F.col("items").cast("array<string>"), ","))).alias("id")))
    classes = whole.groupBy("id").agg(F.first("items").alias("items"), F.count("*").alias("copies"))
    # a number once written stays, and takes half the room of the hash it stands for
    classes = store(classes.select("id", F.monotonically_increasing_id().alias("no"), "items", F.size("items").alias("n"), "copies"))
    return whole.select(*key, "id").join(classes.select("id", "no", "copies"), "id").drop("id"), classes.drop("id")


def similar_classes(classes: DataFrame, least: int = 4, num: int = 7, den: int = 10, small: int = 8) -> DataFrame:
    """(x, y): numbers of different classes that share at least num/den of their union, x < y, each pair once.

    Sets of at most ``small`` items enumerate the subsets of the size that a partner must share; two small sets are
    similar exactly if they meet in one, so that every row a subset's join gives is a similar pair. Larger sets scan the inverted lists
    of their rarest items, as many as a partner can't all miss, against sets of any size that can reach the threshold; a pair
    goes on only if what stands behind the meeting point in both can suffice, and is checked on all items. A list of more than LIST
    entries is dealt over tasks, the scanning side by hash, the other to each.
    """
    subset = classes.where(F.col("n") <= small).select("no", "n", F.col("items").alias("hashes"))
    subset = subset.mapInPandas(_subsets(small, least, num, den), "no long, n int, side int, key long")
    sl = subset.where(F.col("side").bitwiseAND(LEFT) > 0).select(F.col("no").alias("x"), F.col("side").alias("sx"), "key")
    sr = subset.where(F.col("side").bitwiseAND(RIGHT) > 0).select(F.col("no").alias("y"), "key")
    met = sl.join(sr, "key").where((F.col("sx") == LEFT) | (F.col("x") < F.col("y"))).select("x", "y")

    partner = -(-num * (small + 1) // den)  # no smaller set can have a large one as partner
    words = classes.where(F.col("n") >= partner).select("no", "n", F.explode("items").alias("w"))
    count = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(count, "w").groupBy("no", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    prefix = ranked.select("no", "n", F.posexplode(F.expr(f"slice(r, 1, n - cast(ceil(n * {num} / {den}) as int) + 1)")).alias("at", "e"))
    prefix = prefix.select("no", "n", "at", F.col("e.w").alias("w"), F.ceil(F.col("e.df") / LIST).cast("int").alias("parts"))
    pl = prefix.where(F.col("n") > small).select(F.col("no").alias("x"), "n", "at", "w", F.pmod(F.xxhash64("no"), "parts").cast("int").alias("part"))
    pr = prefix.select(F.col("no").alias("y"), F.col("n").alias("m"), F.col("at").alias("bt"), "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    fits = (F.col("m") * den >= F.col("n") * num) & (F.col("m") * num <= F.col("n") * den)
    enough = (1 + F.least(F.col("n") - 1 - F.col("at"), F.col("m") - 1 - F.col("bt"))) * (num + den) >= (F.col("n") + F.col("m")) * num
    scan = pl.join(pr, ["w", "part"]).where(fits & enough & ((F.col("m") <= small) | (F.col("x") < F.col("y")))).select("x", "y").distinct()
    side = lambda c, i: classes.select(F.col("no").alias(c), F.col("items").alias(i))
    shared = F.size(F.array_intersect("p", "q"))
    scan = scan.join(side("x", "p"), "x").join(side("y", "q"), "y").where(shared * den >= (F.size("p") + F.size("q") - shared) * num)
    return met.distinct().unionByName(scan.select("x", "y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def similar_set_pairs(df: DataFrame, key: list[str], item: str, least: int = 4, num: int = 7, den: int = 10, small: int = 8, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs of records whose item sets hold at least ``least`` items each and share at least num/den of their union.

    Rows as for ``set_classes``. Each pair comes once, the smaller key first, as ``key`` columns with the two suffixes. Other
    columns are ignored, whatever their names. An empty table gives an empty result.

    Records with equal sets form one class, and classes are joined, so copies cost nothing until the pairs are written; then
    a class of more than COPIES records is dealt over tasks. Where pairs of copies are not wanted, ``linked_records`` has one
    row a record.
    """
    member, classes = set_classes(df, key, item, least)
    parts = F.ceil(F.col("copies") / COPIES).cast("int")
    rec = member.select("no", F.struct(*key).alias("rec"), F.pmod(F.xxhash64(*key), parts).cast("int").alias("part"))
    same = classes.where("copies > 1").select(F.col("no").alias("x"), F.col("no").alias("y"))
    both = similar_classes(classes, least, num, den, small).unionByName(same)
    for c, p in (("x", "px"), ("y", "py")):  # a class of many records comes in parts, each pair of parts by itself
        large = classes.where(F.col("copies") > COPIES).select(F.col("no").alias(c), parts.alias("n"))
        both = both.join(large, c, "left").withColumn(p, F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
    one = rec.select(F.col("no").alias("x"), F.col("part").alias("px"), F.col("rec").alias("u"))
    two = rec.select(F.col("no").alias("y"), F.col("part").alias("py"), F.col("rec").alias("v"))
    pairs = both.select("x", "px", "y", "py").join(one, ["x", "px"]).join(two, ["y", "py"]).where("x <> y or u < v")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs.select(*[F.col(f"u.{k}").alias(k + suffixes[0]) for k in key], *[F.col(f"v.{k}").alias(k + suffixes[1]) for k in key])


def linked_records(df: DataFrame, key: list[str], item: str, least: int = 4, num: int = 7, den: int = 10, small: int = 8) -> DataFrame:
    """One row per record of at least ``least`` items: ``key``, its class (the smallest record with the same set, ``class_`` columns) and the number of its ``links``.

    A link is a pair that ``similar_set_pairs`` would give; links are counted from classes and copies, so no pair of copies is formed.
    """
    member, classes = set_classes(df, key, item, least)
    met = similar_classes(classes, least, num, den, small)
    copies = classes.select(F.col("no").alias("far"), "copies")
    ends = met.select(F.explode(F.array(F.struct(F.col("x").alias("no"), F.col("y").alias("far")), F.struct(F.col("y").alias("no"), F.col("x").alias("far")))).alias("e")).select("e.*")
    far = ends.join(copies, "far").groupBy("no").agg(F.sum("copies").alias("far"))
    head = member.groupBy("no").agg(F.min(F.struct(*key)).alias("head"), F.max("copies").alias("copies"))
    head = head.join(far, "no", "left").select("no", "head", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return member.join(head, "no").select(*key, *[F.col(f"head.{k}").alias(f"class_{k}") for k in key], "links")
