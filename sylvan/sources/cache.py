"""Extracted rows kept as Parquet, so that unchanged files are not read again."""
from __future__ import annotations

import hashlib
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .extract import VERSION
from .extract.rows import WIDE
from .trees import extract_files, files_frame
from .walk import Found


def default_folder(root: str | Path) -> Path:
    """A folder for this root below the user's cache folder. On a cluster give one that all executors share."""
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return Path(base, "sylvan", hashlib.sha256(os.fspath(Path(root).resolve()).encode()).hexdigest()[:24])


class RowCache:
    """Wide rows before the whole-corpus analyses, with the file's time and size and the extractors' version.

    A file's rows are used again if time, size and version are the same; files that went drop out; what can't be read
    counts as empty. A run writes a new generation next to the old one and then removes the old one.
    """

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, Path(folder)

    def _latest(self) -> tuple[int, Path | None]:
        found = [int(p.name) for p in self.folder.glob("*") if p.name.isdigit() and (p / "files" / "_SUCCESS").exists()]
        return (max(found), self.folder / str(max(found))) if found else (0, None)

    def rows(self, files: list[Found], on_error: str = "fail") -> DataFrame:
        """Wide rows of ``files``; only those that are new or changed are extracted."""
        now = files_frame(self.spark, files).withColumn("version", F.lit(VERSION))
        number, last = self._latest()
        key = ["file", "mtime_ns", "size", "version"]
        old_rows = None
        if last is not None:
            try:
                known = self.spark.read.parquet(str(last / "files"))
                kept = now.join(known.select(*key), key, "left_semi")
                old_rows = self.spark.read.schema(WIDE).parquet(str(last / "rows")).join(kept.select("file"), "file", "left_semi").select(*WIDE.names)
                fresh = now.join(known.select(*key), key, "left_anti")
            except AnalysisException:
                old_rows = None
        if old_rows is None:
            fresh = now
        rows = extract_files(fresh.select("path", "file"), on_error)
        if old_rows is not None:
            rows = rows.unionByName(old_rows)
        new = self.folder / str(number + 1)
        shutil.rmtree(new, ignore_errors=True)
        rows.write.parquet(str(new / "rows"))
        now.select(*key).write.parquet(str(new / "files"))
        if last is not None:
            shutil.rmtree(last, ignore_errors=True)
        return self.spark.read.schema(WIDE).parquet(str(new / "rows"))
