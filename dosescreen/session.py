"""Session defaults and the place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGE_PREFIX = "dosescreen-stage-"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even if that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # no call sites for every single expression; building large plans is several times faster without
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "dosescreen", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> str:
    """Make sure checkpoints go to the shared folder the session names; return that folder.

    A machine-local folder is chosen only for a local master, where driver and executors share a disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="dosescreen-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back from there.

    Used where a later step must see exactly the rows of an earlier one (slice numbers), which a recomputation after a
    lost executor would not guarantee, and where a costly table is read several times. Unlike a checkpoint the written
    table is columnar, and its true size is known to the planner, which can then tell whether it may be broadcast.
    """
    path = f"{use_checkpoints(df.sparkSession)}/{STAGE_PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stage_paths(spark: SparkSession):
    """The file system of the checkpoint folder, and the paths of the written tables in it by name."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        return None, {}
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(path)]
    return files, {p.getName(): p for p in found if p.getName().startswith(STAGE_PREFIX)}


def stage_tables(spark: SparkSession) -> set[str]:
    """The names of the tables this session has written to the checkpoint folder."""
    return set(_stage_paths(spark)[1])


def drop_stages(spark: SparkSession, keep: set[str] | None = None) -> int:
    """Delete the tables this session's :func:`cut_lineage` calls have left, but for ``keep``; returns how many."""
    files, stages = _stage_paths(spark)
    dropped = [p for name, p in stages.items() if name not in (keep or set())]
    for stage in dropped:
        files.delete(stage, True)
    return len(dropped)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes inside the block are deleted at its end, also after a failure.

    Results must be written or collected inside the block, since they read those tables. One block of a session runs at
    a time.
    """
    before = stage_tables(spark)
    try:
        yield
    finally:
        drop_stages(spark, before)
