"""Micro-batches of fingerprints appended to a table as they arrive, and classified as a whole on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_fingerprints(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of fingerprint rows to a parquet table, each batch under its own number.

    A batch that is retried replaces its own directory, so rows are neither lost nor doubled. With once=True the
    query ends when what is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def fingerprints(spark: SparkSession, table_path: str) -> DataFrame:
    """All rows appended so far, one a path: of repeated deliveries the first batch's."""
    rows = spark.read.parquet(table_path)
    names = [c for c in rows.columns if c not in ("path", "batch")]
    return rows.groupBy("path").agg(F.min(F.struct("batch", *names)).alias("r")).select("path", *[f"r.{n}" for n in names])
