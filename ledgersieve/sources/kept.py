"""Intermediate tables written once to the cluster's shared folder.

A table that several later steps read is written here and read back. That cuts
the lineage, survives the loss of executors, and gives the planner the measured
size of the table: a join against it is broadcast only if that size is below
``spark.sql.autoBroadcastJoinThreshold`` and is a shuffle join otherwise.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where a single JVM runs all."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
            configured = tempfile.mkdtemp(prefix="ledgersieve-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


#: Shuffle files are deleted when the query that wrote them ends, not at the driver's next full
#: collection of garbage: what is kept has been written, so nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Writes that run side by side in one session; the first sets, the last puts back what was set before.
_writes: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        running = _writes.setdefault(session, [0, spark.conf.get(_CLEANUP, "false")])
        running[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            running[0] -= 1
            if not running[0]:
                spark.conf.set(_CLEANUP, _writes.pop(session)[1])


#: Folders of the scopes that are open, the innermost last.
_open: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(spark: SparkSession) -> None:
    """Delete all tables that this application has kept; results built on them are gone then."""
    _delete(spark, f"{shared_folder(spark)}/kept")


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables kept within are deleted at its end, also after an error; others stay.

    Results have to be written within. Threads started within keep their tables here too, so
    scopes of one driver follow or contain each other; they don't run side by side.
    """
    folder = f"{shared_folder(spark)}/kept/scope-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield folder
    finally:
        _open.remove(folder)
        _delete(spark, folder)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    The shuffle files of the write are deleted at its end; the session's setting is put back, also
    where several tables are written side by side.
    """
    spark = df.sparkSession
    folder = _open[-1] if _open else f"{shared_folder(spark)}/kept"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables as ``kept`` returned them, where no later step reads them."""
    for table in tables:
        _delete(table.sparkSession, table.kept_path)
