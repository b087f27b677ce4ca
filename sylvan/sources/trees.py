"""Extraction as one parallel stage: files, or rows that hold source text, to the extracted tables."""
from __future__ import annotations

from collections.abc import Collection, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ensure_importable, spread
from ..schema import EXTRACTED
from .extract import extract
from .extract.rows import WIDE, narrow
from .walk import LANGUAGES, Found

_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("file", T.StringType()), T.StructField("mtime_ns", T.LongType()), T.StructField("size", T.LongType())])
#: Source bytes that one task takes, roughly.
TASK_BYTES = 4 << 20
#: Rows given to Spark at a time; a file's rows are never held together with more than this many others.
BATCH = 20_000


def language_column(path: str) -> Column:
    """Language by the last extension, or null; built in the JVM."""
    ext = F.regexp_extract(path, r"(\.[^./\\]+)$", 1)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in WIDE])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while batch := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def files_frame(spark: SparkSession, files: list[Found]) -> DataFrame:
    """The file list, spread so that a task gets about TASK_BYTES of source."""
    parts = max(1, min(len(files), sum(f.size for f in files) // TASK_BYTES + spark.sparkContext.defaultParallelism))
    df = spark.createDataFrame(pd.DataFrame(files, columns=_FILES.names), _FILES) if files else spark.createDataFrame([], _FILES)
    return df.repartition(parts)


def extract_files(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Wide rows of files (path, file). The paths must be readable from every executor.

    A file that is not UTF-8 ends the run, or with on_error='skip' gives nothing.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    ensure_importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, file, lang in zip(*(b.column(c).to_pylist() for c in ("path", "file", "lang")), strict=True):
                    try:
                        with open(path, encoding="utf-8", newline="") as f:
                            text = f.read()
                    except (OSError, UnicodeDecodeError) as e:
                        if on_error == "skip":
                            continue
                        raise RuntimeError(f"error: failed to read {path}: {e}") from e
                    yield from extract(lang, file, text).wide()

        return _batches(rows())

    src = files.select("path", "file", language_column("file").alias("lang")).where("lang is not null")
    return src.mapInArrow(run, WIDE)


def extract_texts(df: DataFrame, file: str = "file", text: str = "text", language: str | None = None, wanted: Collection[str] = EXTRACTED) -> DataFrame:
    """Wide rows of a table that holds whole source files as text; the language by the path, or from a column.

    Rows with a null file or text, or of no supported language, give nothing. Only rows of the ``wanted`` tables leave a task.
    """
    wanted = frozenset(wanted)
    ensure_importable(df.sparkSession)
    lang = language_column(file) if language is None else F.lower(language)
    src = df.select(F.col(file).alias("file"), F.col(text).alias("text"), lang.alias("lang")).where(F.col("lang").isin(*set(LANGUAGES.values())) & F.col("file").isNotNull() & F.col("text").isNotNull())

    src = spread(src)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(r for b in batches for f, t, x in zip(*(b.column(c).to_pylist() for c in ("file", "text", "lang")), strict=True) for r in extract(x, f, t).wide(wanted))

    return src.mapInArrow(run, WIDE)


def tables(wide: DataFrame) -> dict[str, DataFrame]:
    """The extracted tables, each a filter and projection of the wide rows."""
    return {t: narrow(wide, t) for t in EXTRACTED}


def register_extractor(spark: SparkSession, name: str = "extract_source") -> None:
    """A table function for Spark SQL: ``SELECT * FROM extract_source('go', 'a.go', text)`` gives the wide rows of one text."""

    ensure_importable(spark)

    @F.udtf(returnType=WIDE)
    class Extract:
        def eval(self, language: str, file: str, text: str) -> Iterator[tuple]:
            if language in LANGUAGES.values() and file is not None and text is not None:
                yield from extract(language, file, text).wide()

    spark.udtf.register(name, Extract)
