"""New model lines as a stream of files: normalised and appended once, by id.

The grid tables are files that arrive now and then; there is no event time, so the
stream needs no windows.  Each micro-batch is an import of new lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lineweave.sources import readers


def import_stream(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of CSV files; lines whose id the Parquet table has not yet are added."""

    def add(batch: DataFrame, _: int) -> None:
        new = readers.normalize_lines(batch, metres=True).dropDuplicates(["id"])
        try:
            new = new.join(spark.read.parquet(table).select("id"), "id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    source = spark.readStream.schema(schema).option("header", True).csv(folder)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
