"""Session-level helpers: reading tables and cutting lineage."""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_importable(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless they run here and find it by themselves."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_sylvan_sent", False) or (sc.master.startswith("local") and str(root) in seen):
        return
    archive = Path(tempfile.mkdtemp(prefix="sylvan-"), "sylvan.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "sylvan").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))  # the driver serves it to the executors
    sc._sylvan_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; only where none is set, as in local tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sylvan-checkpoint-"))
    if sc.getConf().get(_CLEAN) is None:
        sc._jsc.sc().conf().set(_CLEAN, "true")  # read whenever a checkpoint is written


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; it survives lost executors.

    Spark deletes the files when the frame is no longer used, unless the session says otherwise in
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table, for rows that are wide or read in part; it is deleted when the session's process ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = getattr(sc, "_sylvan_tables", None)
    if folder is None:
        folder = sc._sylvan_tables = f"{sc.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, sc, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def _remove(sc: SparkContext, folder: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone, and with it the right to its folder
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs far more than a shuffle of its input.

    Input with enough splits, as any large one has, stays as it is, and so does a stream.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
