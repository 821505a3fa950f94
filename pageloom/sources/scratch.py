"""Tables that an operator stores on the way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session in one process gets a folder of its own and any other is refused."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="pageloom-")
    return named.rstrip("/")


def path_for(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted with the session."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors cost nothing that was stored."""
    path = path_for(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
