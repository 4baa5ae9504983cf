"""Tables in the folder that driver and executors share; they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only runs on this machine alone may go without, in a temporary folder.

    It is removed when the application ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tarmac_shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarmac-")
        spark._tarmac_shared = root
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def kept(df: DataFrame, tag: str = "step") -> DataFrame:
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
