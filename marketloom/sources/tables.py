"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset the session must be a local one, as in tests; then a temporary folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="marketloom-")  # a running session does not take the setting
        _local[app] = found
    return found


class Tables:
    """Parquet tables in the shared folder that cut lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marketloom-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.saved_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = SparkContext._active_spark_context._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.saved_at)
            p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(p, True)
