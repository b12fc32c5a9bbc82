"""Tables that cut the lineage of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below the folder that the cluster shares (``spark.checkpoint.dir``), deleted when the driver ends.

    Where that is not set a temporary folder serves, but only if driver and executors are one process; else it is an error.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own_folder()
    path = f"{top}/harrow-tables/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="harrow-tables-")
