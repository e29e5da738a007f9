"""Session facts the operators need: shuffle width, broadcast limit, scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest estimated size, in bytes, of a side the library broadcasts.
BROADCAST_LIMIT = 64 * 1024 * 1024


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, size_in_bytes: float, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the known size is within the limit."""
    return F.broadcast(df) if size_in_bytes <= limit else df


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder path all executors can reach.

    It lies under ``spark.checkpoint.dir``. A session without that setting gets a
    machine-local folder if it runs on one machine, and an error otherwise.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="censusloom-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the scratch folder and read it back."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
