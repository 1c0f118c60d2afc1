"""Stored forms of a session's inputs.

A form is a table, or a few, derived once from an input and used again while the session lives and the input stays the same (its bytes,
files and time). Forms lie in the folder that driver and executors share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an input's files for each partition of its forms.
PARTITION_BYTES = 256 << 20
_forms: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, and only in local mode, one of our own."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written down unless they are already: a checkpoint, or rows that came from the driver."""
    return df if df._jdf.queryExecution().logical().getClass().getSimpleName() == "LogicalRDD" else cut(df)


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: the file system and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a path."""
    fs, p = file_system(spark, path)
    told = fs.getContentSummary(p)
    return told.getLength(), told.getFileCount(), fs.getFileStatus(p).getModificationTime()


def partitions(spark: SparkSession, path: str) -> int:
    """Partitions for the forms of an input: as its size asks for, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-state(spark, path)[0] // PARTITION_BYTES))


def form(spark: SparkSession, path: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a form of the input at path; write(folder) makes it, if this session hasn't yet or the input has changed."""
    key, now = (spark.sparkContext.applicationId, path, name), state(spark, path)
    if key not in _forms or _forms[key][0] != now:
        folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        write(folder)
        if key in _forms:
            remove(spark, _forms[key][1])
        _forms[key] = (now, folder)
    return _forms[key][1]


def forget(spark: SparkSession) -> None:
    """Removes the forms that this session has stored."""
    for key in [k for k in _forms if k[0] == spark.sparkContext.applicationId]:
        remove(spark, _forms.pop(key)[1])


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
