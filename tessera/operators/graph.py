"""The mutual-information graph of features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions.stats import entropy, normalized_mi
from tessera.operators.features import RESPONSES, firing_probability
from tessera.sources.storage import exact_percentile


def cooccurrence(features: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """src, dst, n11 (src < dst): streams in which both fire. A stream's cells join on the stream alone, so the cost is
    the sum of squares of cells a stream, which the token limit of a span bounds."""
    f = features.where(F.col("side").isin(*RESPONSES) & (F.col("freq") > 0)).select("row_idx", "side", "feature")
    f = f.join(F.broadcast(keep.select("feature")), "feature", "left_semi") if keep is not None else f
    a, b = f.withColumnRenamed("feature", "src"), f.withColumnRenamed("feature", "dst")
    return a.join(b, ["row_idx", "side"]).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n11"))


def cooccurrence_blocked(features: DataFrame, n_features: int, block: int = 1024, rows: int = 2048) -> DataFrame:
    """The same counts by dense blocks for corpora with many cells a stream: each task multiplies indicator blocks of
    `rows` streams, and partial counts add up. Memory: rows x n_features bits in, block x block counts out."""
    f = features.where(F.col("side").isin(*RESPONSES) & (F.col("freq") > 0)).select("row_idx", "side", "feature")
    chunk = F.expr(f"row_idx DIV {rows}")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        stream = pd.factorize(pdf["row_idx"].astype(str) + pdf["side"])[0]
        x = np.zeros((stream.max() + 1, n_features), np.float32)
        x[stream, pdf["feature"]] = 1
        out = []
        for i in range(0, n_features, block):
            for j in range(i, n_features, block):
                p = x[:, i : i + block].T @ x[:, j : j + block]
                a, b = np.nonzero(np.triu(p, 1) if i == j else p)
                out.append(pd.DataFrame({"src": a + i, "dst": b + j, "n11": p[a, b].astype("int64")}))
        return pd.concat(out)

    part = f.withColumn("__c", chunk).groupBy("__c").applyInPandas(multiply, "src int, dst int, n11 long")
    return part.groupBy("src", "dst").agg(F.sum("n11").alias("n11"))


def mi_pairs(features: DataFrame, n: int, min_p: float = 0.001) -> DataFrame:
    """src, dst, n11, weight for all pairs of active features, those that never fire together included.

    The pair grid is features squared, whatever the rows: it is the operator's own output before the cut.
    """
    p = firing_probability(features, n).where(F.col("p1") > min_p).select("feature", "p1")
    n11 = cooccurrence(features, p)
    a, b = p.select(F.col("feature").alias("src"), F.col("p1").alias("pi")), p.select(F.col("feature").alias("dst"), F.col("p1").alias("pj"))
    pairs = a.join(b, F.col("src") < F.col("dst")).join(n11, ["src", "dst"], "left").fillna(0, ["n11"])
    return pairs.select("src", "dst", "n11", normalized_mi(F.col("n11") / (2.0 * n), F.col("pi"), F.col("pj")).alias("weight"))


def edges(pairs: DataFrame, top_percent: float = 1.0) -> DataFrame:
    """Pairs at or above the percentile of the positive weights."""
    positive = pairs.where("weight > 0")
    cut = exact_percentile(positive, "weight", 1 - top_percent / 100, "cut")
    return positive.join(F.broadcast(cut), F.col("weight") >= F.col("cut")).select("src", "dst", "weight")


def entropies(features: DataFrame, n: int) -> DataFrame:
    return firing_probability(features, n).select("feature", "p1", entropy(F.col("p1")).alias("h"))


def internal_edges(edges_: DataFrame, clusters: DataFrame, min_size: int = 20) -> DataFrame:
    """m, size, n_edges, density (percent of possible) for clusters of min_size features or more."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    a, b = clusters.select(F.col("feature").alias("src"), "m"), clusters.select(F.col("feature").alias("dst"), F.col("m").alias("m2"))
    inside = edges_.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").where("m = m2").groupBy("m").agg(F.count(F.lit(1)).alias("n_edges"))
    return size.join(inside, "m", "left").fillna(0, ["n_edges"]).withColumn("density", 200.0 * F.col("n_edges") / (F.col("size") * (F.col("size") - 1)))
