"""Tables in the shared folder: scratch paths, fingerprints, resume, row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a folder of our own only where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera_")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, *sort: str) -> DataFrame:
    """Write and read back; `sort` orders rows within files so that row-group statistics prune."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was committed at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def fingerprint(ids: DataFrame, column: str = "example_id", d: int | None = None) -> DataFrame:
    """One row: n, d and a 16-digit digest of the ids, each block of 4,096 ids hashed first so no task holds them all."""
    block = ids.select(F.col(column).alias("x")).groupBy(F.expr("x DIV 4096").alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("x").cast("string"))), ","), 256).alias("h"), F.count(F.lit(1)).alias("c"))
    return block.agg(F.sum("c").alias("n"), F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256), F.lit(16)).alias("ex_hash")).select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(d).cast("int").alias("d"), "ex_hash")


def pending(all_rows: DataFrame, done: DataFrame, key: str = "row_idx") -> DataFrame:
    """Rows that an earlier run hasn't written yet."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_idx") -> DataFrame:
    """df with dense numbers from 0 in the given order, without a window over all rows.

    Range partitions are sorted and written once; a row's number is its place in the partition plus the counts of the
    partitions before it (one row each).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = save(placed, scratch(spark, "numbered"))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"))
    return placed.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + place).drop("__p", "__id", "__before")


def exact_percentile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row: the exact percentile of a column's values that aren't null, linear between neighbours; null without any.

    Values are numbered over range partitions and the two neighbours fetched by number, so no task or driver holds more
    than a partition, however many distinct values there are.
    """
    placed = number_rows(df.select(column).where(F.col(column).isNotNull()), [column], "__i")
    at = (placed.count() - 1) * share
    low, high = int(at // 1), int(-(-at // 1))
    two = placed.where(F.col("__i").isin(low, high)).agg(F.min_by(column, "__i").alias("a"), F.max_by(column, "__i").alias("b"))
    return two.select((F.col("a") if low == high else (high - at) * F.col("a") + (at - low) * F.col("b")).alias(name))
