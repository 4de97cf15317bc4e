"""Tables written once in the cluster's shared folder, to cut lineage.

The folder is ``spark.checkpoint.dir``; only where that is unset (tests, a laptop)
a temporary folder of the driver's machine is used.  A written table is committed
as a whole by Spark, so a lost executor costs a task retry and never a half table.
A table is dropped once those made of it are written themselves; so are the shuffle
files of a write, which nothing reads again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Written tables that may still be dropped, and their folders.
_paths: dict[int, tuple[DataFrame, str]] = {}


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    global _local
    if _local is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _local


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, label: str, by: str | None = None, instead_of: Sequence[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; then drop the written tables it stands for."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    for table in instead_of:
        drop(table)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = table, path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table that write() gave, where nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(id(table))[1])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
