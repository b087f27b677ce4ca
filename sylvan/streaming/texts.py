"""Source files arriving as rows of a stream: extraction and call statistics with Structured Streaming."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.extract.rows import narrow
from ..sources.trees import extract_texts


def stream_table(stream: DataFrame, table: str, file: str = "file", text: str = "text", language: str | None = None) -> DataFrame:
    """One extracted table as a stream, from a stream of source texts. Stateless: each text is parsed once, when it arrives.

    The whole-corpus analyses need every file and run over the written table. Rows with a null file or text give nothing.
    """
    return narrow(extract_texts(stream, file, text, language), table)


def newest_scan(rows: DataFrame, keys: list[str], at: str, late: str, columns: list[str]) -> DataFrame:
    """Of rows scanned several times the newest, as a stream with bounded state: scans later than ``late`` are left out.

    Groups are kept by keys and day of the scan, which the watermark closes.
    """
    day: Column = F.window(at, "1 day")
    best = F.max_by(F.struct(*columns), F.col(at))
    got = rows.withWatermark(at, late).groupBy(*keys, day.alias("day")).agg(F.max(at).alias(at), best.alias("best"))
    return got.select(*keys, F.col("day.start").alias("day"), at, *[F.col(f"best.{c}").alias(c) for c in columns])
