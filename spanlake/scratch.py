"""A new folder for each use, where all executors can reach it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir. Where that is unset, a temporary folder becomes it if the session is one process, as in tests; on a cluster, whose
    executors don't see each other's folders, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/spanlake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to a new folder and read again, so that a lost executor can't change what was numbered by partition."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
