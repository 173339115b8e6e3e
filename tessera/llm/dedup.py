"""Exact deduplication as a stateful stream over an arrivals log, in DataFrame and streaming built-ins only.

Each arrival is (digest, doc_id, content locator). A streaming aggregation over RocksDB state, with no watermark and so
without expiry, keeps for every digest the row that stays (largest doc_id), its locator and the number of arrivals.
Arrivals that hit a digest already present are then compared byte by byte before anything is dropped; if a digest ever
stands for different bytes, its rows are grouped anew by the bytes themselves.

Scale: the log holds about 100 bytes a row, texts are never in the state, copies collapse before every shuffle of the
stream, and only the final join by digest sees hot groups, whose large side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import FILE, ROW, Tables, ascii_lower, located, remove, scratch, without

#: State on disk, its memory bounded over all stores of an executor; commits write what changed and reserve no space ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def ingest(spark: SparkSession, log: str, schema, checkpoint: str, bytes_per_trigger: int = 16 << 30) -> None:
    """Fold what is new in the log into the state below `checkpoint`; may be called again after the log has grown."""
    saved = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(log)
        state = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state as a table: digest, keep_id, keep_file, keep_row, group_size."""
    got = spark.read.format("statestore").load(checkpoint)
    keep, n = got.schema["value"].dataType.names
    return got.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{keep}.doc_id").alias("keep_id"), F.col(f"value.{keep}.{FILE}").alias("keep_file"), F.col(f"value.{keep}.{ROW}").alias("keep_row"), F.col(f"value.{n}").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, digest=sha256_digest, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, FILE and ROW (the locator).

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays. Null text: empty text,
    and empty texts are equal. Null doc_id: smaller than any other. Rows that repeat both text and doc_id: the one with
    the largest locator stays, so exactly one row of a group is kept. Empty table: empty result. Other columns of docs
    are ignored, whatever their names. `digest` may be replaced, a weak one too: hits are checked on the full bytes.
    """
    return _exact(located(docs, "dedup-docs", F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), digest)


def _exact(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    spark = docs.sparkSession
    t, ck = Tables(spark, "dedup"), scratch(spark, "dedup-state")
    norm = ascii_lower(F.col("text"))
    arrivals = t.save(docs.select(digest(norm).alias("digest"), "doc_id", FILE, ROW), "log")
    ingest(spark, t.paths["log"], arrivals.schema, ck)
    state = t.save(read_state(spark, ck), "keep")
    remove(spark, ck)

    hits = arrivals.join(state.where("group_size > 1").select("digest"), "digest").select(FILE, ROW, "digest")
    texts = docs.join(hits, [FILE, ROW]).select("digest", ascii_lower(F.col("text")).alias("norm"))
    differ = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest")
    differ = t.save(differ, "differ")

    sha = F.lower(F.hex("digest")) if digest is sha256_digest else F.lit(None).cast("string")
    one = lambda df: df.select("doc_id", "keep_id", "group_size", ((F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))).alias("kept"), "text_sha256", FILE, ROW)
    if digest is sha256_digest and differ.isEmpty():
        return one(arrivals.join(state, "digest").withColumn("text_sha256", sha))
    return one(_by_bytes(docs, arrivals, state, differ))


def _by_bytes(docs: DataFrame, arrivals: DataFrame, state: DataFrame, differ: DataFrame) -> DataFrame:
    """What exact_dedup gives where a digest stood for different bytes: those rows are grouped by the bytes."""
    norm = ascii_lower(F.col("text"))
    rows = docs.join(arrivals.select(FILE, ROW, "digest"), [FILE, ROW])
    same = rows.join(differ, "digest", "left_anti").join(state, "digest").select("doc_id", FILE, ROW, "keep_id", "keep_file", "keep_row", "group_size", F.sha2(norm, 256).alias("text_sha256"))
    other = rows.join(differ, "digest", "left_semi").select("doc_id", FILE, ROW, norm.alias("norm"))
    best = other.groupBy("norm").agg(F.max(F.struct("doc_id", FILE, ROW)).alias("k"), F.count(F.lit(1)).alias("group_size"))
    other = other.join(best, "norm").select("doc_id", FILE, ROW, F.col("k.doc_id").alias("keep_id"), F.col(f"k.{FILE}").alias("keep_file"), F.col(f"k.{ROW}").alias("keep_row"), "group_size", F.sha2("norm", 256).alias("text_sha256"))
    return same.unionByName(other)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay as they are."""
    return without(docs, "dedup-in", lambda rows: _exact(rows).where("NOT kept"))
