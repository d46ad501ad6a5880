"""Intermediate tables in the folder all executors share.

The folder is `spark.checkpoint.dir`; where a session has none (tests), `local_default` sets one.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets one below the temp folder for local sessions without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/sluice-scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: lineage ends there.

    The tables of a session go when Python ends; `drop` and `clear` remove them earlier.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _made:
        atexit.register(clear, spark)
    _made.setdefault(app, []).append(path)
    # Shuffle files of the job just done stay until the driver's JVM drops its plan. These jobs shuffle much and
    # allocate little there, so ask for it.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(frame.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing reads any more; frames derived from them must not be used afterwards."""
    for table in tables:
        spark, path = table.sparkSession, table.scratch_path
        made = _made.get(spark.sparkContext.applicationId, [])
        if path in made:
            made.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables this session wrote; frames that read them must not be used afterwards."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for path in _made.pop(context.applicationId, []):
        _delete(spark, path)
