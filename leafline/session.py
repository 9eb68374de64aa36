"""Session helpers: table paths, shared storage, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only a local session without that setting, as in tests, falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "leafline-" + spark.sparkContext.applicationId)
    os.makedirs(made, exist_ok=True)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` from reliable files in the shared folder, computed once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_own(spark, os.path.join(shared_dir(spark), "lineage-" + uuid.uuid4().hex[:8])))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets shuffle files go whose plans nobody holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Folders of this process in the shared folder, by application.
_made: dict[str, list[str]] = {}


def _own(spark: SparkSession, path: str) -> str:
    if not _made:
        atexit.register(_clean_at_exit)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes what this session wrote into the shared folder; results that still read it must have been stored."""
    jvm = spark.sparkContext._jvm
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _clean_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clean(spark)
    except Exception:
        pass  # the session is gone already


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: a columnar lineage cut."""
    spark = df.sparkSession
    path = _own(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.parquet(path)
