"""Derived tables that are written once and read many times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; in local mode alone a temporary one stands in where none is set."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="twinfold-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(f"file://{made}")
    return context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it comes from fewer files than there are: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def state_of(source: DataFrame) -> tuple:
    """Files that a table is read from, with their lengths and times: another state is another table."""
    jvm, conf = source.sparkSession._jvm, source.sparkSession._jsc.hadoopConfiguration()
    out = []
    for name in sorted(source.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))  # names are encoded as in addresses
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def stored(spark: SparkSession, name: str, source: DataFrame, make: Callable[[str], None]) -> str:
    """Folder of what ``make(folder)`` writes, made once for each state of ``source`` and application.

    A folder that could not be finished is never handed out; the next call starts another.
    """
    key = (spark.sparkContext.applicationId, name, state_of(source))
    if key not in _written:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make(folder)
        _written[key] = folder
    return _written[key]
