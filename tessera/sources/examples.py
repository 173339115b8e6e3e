"""Preference examples: loading, turn extraction, trimming, point lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.functions.stats import strip
from tessera.sources.storage import number_rows

SIDES = ("prompt", "chosen", "rejected")


def span(df: DataFrame, column: str, side: str, chosen: str) -> Column:
    """A side's text: a string column as it is; of dialogue turns the last one, for the prompt the first of `chosen`."""
    if column not in df.columns and side != "prompt":
        return F.lit("")
    if isinstance(df.schema[chosen].dataType if chosen in df.columns else None, T.ArrayType) and side == "prompt":
        return F.coalesce(F.try_element_at(F.col(chosen), F.lit(1))["content"], F.lit(""))
    if column not in df.columns:
        return F.lit("")
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.coalesce(F.try_element_at(F.col(column), F.lit(-1))["content"], F.lit(""))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def extract(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", id_col: str = "example_id", max_samples: int = 0) -> DataFrame:
    """example_id, prompt, chosen, rejected: trimmed, rows with an empty span left out, of the first max_samples raw rows by id."""
    if max_samples > 0:
        df = number_rows(df, [id_col], "__raw").where(F.col("__raw") < max_samples)
    spans = [strip(span(df, c, s, chosen)).alias(s) for s, c in zip(SIDES, (prompt, chosen, rejected), strict=True)]
    return df.select(F.col(id_col).alias("example_id"), *spans).where("prompt <> '' AND chosen <> '' AND rejected <> ''")


def load(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None, **columns) -> DataFrame:
    """Examples from parquet, orc, JSON lines or a JSON array; `split` picks a partition directory `split=...`."""
    reader = spark.read.option("multiLine", "true") if fmt == "json_array" else spark.read
    df = reader.format("json" if fmt.startswith("json") else fmt).load(path)
    if split is not None and "split" in df.columns:
        df = df.where(F.col("split") == split)
    return extract(df, **columns)


def lookup(df: DataFrame, start: int, stop: int | None = None, n: int | None = None, key: str = "row_idx") -> DataFrame:
    """Row `start`, or rows start..stop-1; negative numbers count from the end of `n` rows. The filter reaches the scan."""
    fix = lambda i: i + n if i < 0 and n is not None else i
    a = fix(start)
    return df.where(F.col(key) == a) if stop is None else df.where((F.col(key) >= a) & (F.col(key) < fix(stop)))
