"""Tables written to the shared folder: where lineage is cut, so that a lost executor costs a re-read."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"unitlens-llm-{application}-")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The shuffle files behind it are of no more use, but Spark deletes them only when the driver collects its garbage, by
    default every 30 minutes; a job of many written steps would fill the executors' disks with them. So it is told to.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Fail early, by name, when an operator's input lacks a column. Further columns are not looked at."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"input lacks {missing}; it has {df.columns}")
    return df
