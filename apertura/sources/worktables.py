"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="apertura-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir(spark.sparkContext.applicationId)


#: The folders of tables that written() made, for those that still may be dropped.
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    A table that it comes ``instead`` of is deleted once it is there; nothing else may still need that one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/apertura/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    if instead is not None and (old := _tables.pop(instead, None)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out
