"""Tables replayed as streams: rows go file by file into a folder, a stream reads them in that order and ends when all are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import shared_folder


def feed(rows: DataFrame, batch: str, batches: int, folder: str) -> None:
    """The rows of each number 0..batches-1 of column ``batch`` as one more write into ``folder``, in turn."""
    spark, whole = rows.sparkSession, f"{folder}-all"
    rows.write.partitionBy(batch).parquet(whole)
    held = spark.read.schema(rows.schema).parquet(whole)
    for k in range(batches):
        # One file a batch: a trigger takes one file.
        held.where(F.col(batch) == k).drop(batch).coalesce(1).write.mode("append").parquet(folder)


def replay(rows: DataFrame, batch: str, batches: int, query: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``query`` of the stream of ``rows`` has written when all its micro-batches have run, one for each number of ``batch``.

    State and offsets are kept in the shared folder, so a run that is cut short goes on where
    it was; the sink's files are read back as a table.
    """
    spark = rows.sparkSession
    at = shared_folder(spark, "stream")
    feed(rows, batch, batches, f"{at}/in")
    stream = spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    asked = query(stream)
    running = asked.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(asked.schema).parquet(f"{at}/out")
