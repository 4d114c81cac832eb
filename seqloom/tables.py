"""Intermediate tables in the folder that all machines of the cluster share.

A written table cuts the lineage: when an executor is lost, later stages read the files again and nothing before them is
computed anew. The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is unset in a local session
(as in tests) a folder of this process is made and removed at exit.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of this process, where the session names none.
_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many threads are writing, and what the setting was before the first of them.
_WRITING, _LOCK = {"n": 0, "before": "false"}, threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session without one gets a folder of this process; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="seqloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        path = _OWN[0]
    return path.rstrip("/")


def _writing(spark: SparkSession, change: int) -> None:
    """Shuffle files go after use while anyone writes; the setting returns to what it was with the last writer."""
    with _LOCK:
        if change > 0 and not _WRITING["n"]:
            _WRITING["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _WRITING["n"] += change
        if not _WRITING["n"]:
            spark.conf.set(_CLEANUP, _WRITING["before"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    The shuffle files behind it are given back as soon as it is written, since nobody reads them again. The files of the table
    belong to the run; `discard` removes one that is used up, the rest goes with the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _writing(spark, 1)
    try:
        df.write.parquet(path)
    finally:
        _writing(spark, -1)
    out = spark.read.schema(schema).parquet(path)
    out._seqloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table from `materialize`; reading it afterwards fails."""
    jvm, path = df.sparkSession._jvm, df._seqloom_path
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
