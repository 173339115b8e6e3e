"""Incremental ingest: sufficient statistics of the Welch tests over a stream of cells. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.storage import scratch


def statistics(cells: DataFrame) -> DataFrame:
    """k, m, n, s, q: count, sum and sum of squares; they add up over any split of the rows."""
    return cells.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))


def stream_statistics(spark: SparkSession, path: str, schema, files_per_batch: int = 1, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The statistics of an events table, read as a stream of files and merged from the batches' own statistics.

    Each batch writes its statistics below its number, so a batch that runs again replaces its own output; the
    checkpoint holds which files are done, and a later call with the same folders `out` and `checkpoint` goes on from there.
    """
    out, checkpoint = out or scratch(spark, "stream-stats"), checkpoint or scratch(spark, "stream-state")
    cells = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    cells = cells.select((F.col("user_id") % 8).cast("int").alias("k"), F.col("event_type").alias("m"), F.col("value").alias("u"))

    def fold(batch: DataFrame, number: int) -> None:
        statistics(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = cells.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("k", "m").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
