"""Tables in the folder that all executors share, for lineage that must be cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_kept: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder: under spark.checkpoint.dir, or in local mode a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="bitloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = f"file://{_own[0]}"
    return f"{at.rstrip('/')}/bitloom"


def new_path(spark: SparkSession, name: str) -> str:
    """In a folder of the application, which its JVM deletes when it ends."""
    at = f"{scratch(spark)}/{spark.sparkContext.applicationId}"
    if at not in _kept:
        _kept.add(at)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(conf)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a table in the shared folder: lost executors cost no recomputation."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written() table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = scratch(spark).split("://")[-1]
    for at in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if root in at:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
