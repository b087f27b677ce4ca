"""Whole-corpus analyses of the code tables: test flags, lists, call sets."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dirname, lower_ascii, normalize_list, test_key


def flag_by_key(df: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``df`` with ``flag`` set where its key occurs in ``keys``; a flag that is set stays set. Keys with nulls match nothing."""
    hits = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    got = df.join(hits, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.col("__hit").isNotNull())
    return got.select(*df.columns)


def mark_tested(functions: DataFrame) -> DataFrame:
    """``has_test`` of functions that a test in the same directory is named after, ASCII case ignored."""
    pkg, key = dirname("file"), lower_ascii(test_key("name"))
    keys = functions.select(pkg.alias("__pkg"), key.alias("__key")).where("__key is not null")
    named = functions.withColumns({"__pkg": pkg, "__key": lower_ascii("name")})
    return flag_by_key(named, keys, ["__pkg", "__key"], "has_test").select(*functions.columns)


def normalize_implements(structs: DataFrame) -> DataFrame:
    """``implements`` as a plain comma list without blanks, empty parts and repeats."""
    return structs.select(*[normalize_list("implements").alias(c) if c == "implements" else F.col(c) for c in structs.columns])


def call_sets(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, name, callee): distinct callees of every caller; line of the first function of that name in the file, 0 if none."""
    first = functions.groupBy("file", "name").agg(F.min("line").alias("line"))
    pairs = calls.where("caller <> ''").select("file", F.col("caller").alias("name"), "callee").distinct()
    return pairs.join(first, ["file", "name"], "left").select("file", F.coalesce("line", F.lit(0)).cast("long").alias("line"), "name", "callee")


def count_callees(fingerprints: DataFrame, callsets: DataFrame) -> DataFrame:
    """``unique_callee_count`` from the call sets of (file, name); what has none keeps its count."""
    n = callsets.groupBy("file", "name").agg(F.count("*").alias("__n"))
    got = fingerprints.join(n, ["file", "name"], "left")
    return got.select(*[F.coalesce("__n", c).alias(c) if c == "unique_callee_count" else F.col(c) for c in fingerprints.columns])
