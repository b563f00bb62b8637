"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_writer(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """write(table, name) -> the table as read back: its lineage is cut, and it outlives lost executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='citegraph-')}"
    root = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def write(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{root}/{name}")
        return spark.read.schema(table.schema).parquet(f"{root}/{name}")

    def exists() -> bool:
        """Whether what was written is still there."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    write.exists = exists
    return write
