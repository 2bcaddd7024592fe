"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held, _lock = {"writers": 0, "before": None}, threading.Lock()


def local_session(cores: int | str = 8, app: str = "tickloom") -> SparkSession:
    """Session for tests and single-node benches; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a ``local[...]`` master (tests, benches) falls back on a temporary folder; elsewhere a missing setting raises.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tickloom-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from the files.

    Used where a plan reads the same intermediate table several times (scans with a
    carry, estimator fits). The files are in shared storage, so a lost executor costs a
    re-read and not a re-run of the whole lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage.

    The session's own setting returns with the last writer, whichever thread that is.
    """
    with _lock:
        if not _held["writers"]:
            _held["before"] = spark.conf.get(SHUFFLE_CLEANUP, None)
        _held["writers"] += 1
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _held["writers"] -= 1
            if not _held["writers"]:
                spark.conf.unset(SHUFFLE_CLEANUP) if _held["before"] is None else spark.conf.set(SHUFFLE_CLEANUP, _held["before"])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files, with pruning and statistics."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table once everything that reads it has itself been written."""
    sc = staged.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(staged.staged_in)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
