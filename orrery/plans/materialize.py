"""Cutting the lineage of iterative jobs: tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir. A local master, whose
    executors are the driver, may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = here.get() if here.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Where to write a table of this application; all of them go when it ends."""
    context, shared = spark.sparkContext, shared_folder(spark)
    key = (context.applicationId, shared)
    if key not in _FOLDERS:
        folder = f"{shared}/orrery-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[key] = folder
    return f"{_FOLDERS[key]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written once and read again, so that nothing before it is run twice or lost with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """A table that written() made goes before the application ends; nothing may read it any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
