"""The engine: code tables from a tree, from texts or from DataFrames, and queries over them."""
from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .operators.analysis import call_sets, count_callees, mark_tested, normalize_implements
from .operators.attach import attach_comments
from .operators.similarity import similarities
from .plans import compile_query, parse_query
from .runtime import ensure_importable
from .schema import SCHEMAS
from .sources.cache import RowCache
from .sources.trees import extract_files, extract_texts, files_frame, tables
from .sources.walk import source_files


def second_pass(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All nine tables from the extracted ones. Lazy: a query computes the tables it names, and what they need."""
    callsets = call_sets(raw["calls"], raw["functions"])
    structs = normalize_implements(raw["structs"])
    fingerprints = count_callees(raw["fn_fingerprints"], callsets)
    return dict(raw) | {
        "functions": mark_tested(raw["functions"]),
        "structs": structs,
        "comments": attach_comments(raw["comments"], raw["functions"], structs),
        "fn_callsets": callsets,
        "fn_fingerprints": fingerprints,
    }


class Engine:
    """Named tables and queries over them.

    >>> Engine.from_path(spark, "src").sql("SELECT name, file FROM functions WHERE complexity > 10 AND has_test = false")
    """

    def __init__(self, spark: SparkSession, named: Mapping[str, DataFrame], extended: bool = False):
        ensure_importable(spark)
        self.spark, self.extended = spark, extended
        self._tables = {k.lower(): v for k, v in named.items()}
        self._held: list[DataFrame] = []

    @classmethod
    def from_tables(cls, spark: SparkSession, named: Mapping[str, DataFrame], extended: bool = False) -> Engine:
        """An engine over given DataFrames; code tables that are missing are empty."""
        return cls(spark, {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()} | dict(named), extended)

    @classmethod
    def _from_wide(cls, spark: SparkSession, wide: DataFrame, persist: bool, extended: bool) -> Engine:
        if persist:  # else a join of three tables would read every file three times
            wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
        engine = cls(spark, second_pass(tables(wide)), extended)
        engine._held = [wide] if persist else []
        return engine

    @classmethod
    def from_path(cls, spark: SparkSession, root: str | Path, cache: str | Path | None = None, on_error: str = "fail", persist: bool = True, extended: bool = False, warn: bool = False) -> Engine:
        """An engine over the source files under ``root``; ``cache`` names a folder that keeps the rows of unchanged files."""
        files = source_files(root, warn)
        if cache is not None:
            return cls._from_wide(spark, RowCache(spark, cache).rows(files, on_error), False, extended)
        return cls._from_wide(spark, extract_files(files_frame(spark, files), on_error), persist, extended)

    @classmethod
    def from_texts(cls, spark: SparkSession, df: DataFrame, file: str = "file", text: str = "text", language: str | None = None, persist: bool = True, extended: bool = False) -> Engine:
        """An engine over a table that holds source files as texts."""
        return cls._from_wide(spark, extract_texts(df, file, text, language), persist, extended)

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held = []

    def table(self, name: str) -> DataFrame:
        """One table; ``similarities`` is planned when it is first asked for, since scoring needs the number of functions."""
        df = self._lookup(name)
        if df is None:
            raise KeyError(name)
        return df

    def _lookup(self, path: str) -> DataFrame | None:
        name = path.lower()
        if name == "similarities" and name not in self._tables and "fn_fingerprints" in self._tables:
            self._tables[name] = similarities(self._tables["fn_fingerprints"], self._tables["fn_callsets"])
        if name in ("information_schema.tables", "information_schema.columns"):
            return self._information(name.rpartition(".")[2])
        return self._tables.get(name)

    def _information(self, what: str) -> DataFrame:
        names = sorted({*self._tables, *SCHEMAS})
        if what == "tables":
            return self.spark.createDataFrame([("main", n) for n in names], "table_schema string, table_name string")
        rows = [("main", n, f.name, i, f.dataType.simpleString()) for n in names for i, f in enumerate((SCHEMAS.get(n) or self._tables[n].schema).fields, 1)]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")

    def sql(self, text: str) -> DataFrame:
        """The plan of a query in the engine's dialect. Errors in syntax, names and types are raised here, before any file is read."""
        return compile_query(self._lookup, parse_query(text, self.extended))

    def create_views(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for Spark SQL in full; their names, with ``prefix`` in front."""
        names = sorted({*self._tables, *(["similarities"] if "fn_fingerprints" in self._tables else [])})
        for n in names:
            self.table(n).createOrReplaceTempView(prefix + n)
        return [prefix + n for n in names]

    def select_functions(self) -> DataFrame:
        """All functions, ordered by file, line and name."""
        return self.table("functions").orderBy("file", "line", "name")
