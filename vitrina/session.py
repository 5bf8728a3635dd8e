"""Session defaults and lineage control."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package relies on.  Nothing here is sized for a
#: particular data volume: partition counts are left to AQE, which coalesces or
#: splits from the cluster's own ``spark.sql.shuffle.partitions``.  Index joins turn
#: small inputs into many pairs, so AQE may keep partitions far below its default
#: minimum while cores are free.  Files are compressed, so a table whose files look small is
#: many times larger in the driver when broadcast: the limit by files is lower than the
#: limit by rows that AQE has counted.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a session of one machine (``local[...]``, as in tests) gets a temporary folder
    where none is named; on a cluster that would be another folder on every machine, so
    it is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Tables that :func:`passing_tables` deletes at its end.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing_tables", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What :func:`cut_lineage` writes inside is deleted at the end, but for tables that stay.

    For steps of which only a written result is read afterwards.
    """
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, stays: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the checkpoint folder and continue from it.

    For tables that several branches of a plan read (distinct token sets, distinct
    pictures) and for the state of loops: an executor loss then costs the current step,
    not the whole history, later reads are columnar and pruned, and the planner knows
    the table's size.  ``stays``: also where :func:`passing_tables` deletes others;
    ``codec``: how the files are compressed, else as the session has it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    if not stays and _PASSING.get() is not None:
        _PASSING.get().append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Size up to which :func:`spread` deals out a table.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out a table that is stored in fewer pieces than there are cores.

    A table of one small file would otherwise be worked on by one task, broadcast joins
    included.  Tables with enough splits, and all tables above ``SPREAD_BYTES``, are returned
    untouched, so nothing of size is shuffled; AQE merges what turns out too small to be
    worth a task.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(key)
