"""Watch mode: poll the tree, and answer the query again when a file came, went or changed.

A stream over files would see new paths only, neither edits nor removals, so the tree's snapshot is compared instead;
with a cache only changed files are extracted again.
"""
from __future__ import annotations

import sys
import time
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from ..engine import Engine
from ..sinks import write_result
from ..sources.walk import detect_languages, snapshot

#: Seconds between looks, and what clears a terminal.
INTERVAL, CLEAR = 0.5, "\x1b[H\x1b[2J"


def answer(spark: SparkSession, query: str, root: str | Path, form: str, out: TextIO, cache: str | Path | None = None) -> None:
    engine = Engine.from_path(spark, root, cache=cache)
    try:
        df = engine.sql(query)
        out.write(CLEAR)
        write_result(df, form, out)
        out.flush()
    finally:
        engine.close()


def watch(spark: SparkSession, query: str, root: str | Path, form: str = "table", out: TextIO = sys.stdout, cache: str | Path | None = None, interval: float = INTERVAL, go_on: Callable[[], bool] = lambda: True) -> None:
    """Until ``go_on`` says no, or the first error."""
    if not detect_languages(root):
        print(f"warning: no supported source files found in {root}", file=sys.stderr)
    seen = snapshot(root)
    answer(spark, query, root, form, out, cache)
    while go_on():
        time.sleep(interval)
        now = snapshot(root)
        if now != seen:
            seen = now
            answer(spark, query, root, form, out, cache)
