"""Scratch tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, notebooks on one
machine) a local temporary folder is used, since there the driver and the executors are one process.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables; raises on a cluster that names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="corpusmill-"))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one operator run: they cut lineage and survive lost executors.

    ``keep`` writes a DataFrame and returns one that reads it back; ``drop`` deletes a table that nothing will
    read again. What is left is deleted when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusmill-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                drop_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before
            pass
