"""Per-example primitives of the feature-conditioned view: s, u, v, norms, silent rows, data clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.features import RESPONSES, signed
from tessera.sources.storage import exact_percentile


def scores(features: DataFrame, clusters: DataFrame, tau: float = 0.01, weighted: bool = False) -> DataFrame:
    """row_idx, m, s, u_num, u, v: activity, signed firing count, disparity, continuous disparity; absent = 0.

    clusters(feature, m) joins by broadcast where it is small enough for Spark's threshold, else by a shuffle.
    """
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("t_m"))
    cell = features.where(F.col("side").isin(*RESPONSES)).join(clusters, "feature")
    out = cell.groupBy("row_idx", "m").agg(F.sum("freq").alias("s"), F.sum(signed("freq")).alias("v"), F.sum(F.when(F.col("freq") > tau, F.when(F.col("side") == "C", 1).otherwise(-1)).otherwise(0)).alias("u_num"))
    out = out.join(F.broadcast(size), "m")
    return out.select("row_idx", "m", "s", "u_num", ((F.col("v") if weighted else F.col("u_num")) / F.col("t_m")).alias("u"), "v", "t_m")


def norms(scores_: DataFrame, examples: DataFrame) -> DataFrame:
    """row_idx, s_norm for every example; 0 without a cell."""
    n = scores_.groupBy("row_idx").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("s_norm"))
    return examples.select("row_idx").join(n, "row_idx", "left").fillna(0.0, ["s_norm"])


def silent(norms_: DataFrame, percent: float = 5.0) -> DataFrame:
    """norms with gamma (exact percentile, linear between neighbours) and silent: s_norm < gamma."""
    gamma = exact_percentile(norms_, "s_norm", percent / 100, "gamma")
    return norms_.crossJoin(F.broadcast(gamma)).withColumn("silent", F.col("s_norm") < F.col("gamma"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """row_idx, k, cosine: the nearest of centroids(k, m, x) by cosine to vectors(row_idx, m, x); ties: smaller k.

    One assignment step of spherical k-means in joins only; the products go through the shared keys m.
    """
    c = centroids.join(centroids.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("cn")), "k").where("cn > 0").select("k", "m", (F.col("x") / F.col("cn")).alias("cx"))
    n = vectors.groupBy("row_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).where("n > 0")
    dots = vectors.join(F.broadcast(c), "m").groupBy("row_idx", "k").agg(F.sum(F.col("x") * F.col("cx")).alias("dot")).join(n, "row_idx").select("row_idx", "k", (F.col("dot") / F.col("n")).alias("cosine"))
    return dots.groupBy("row_idx").agg(F.max(F.struct(F.round("cosine", 9).alias("c"), (-F.col("k")).alias("nk"))).alias("b")).select("row_idx", (-F.col("b.nk")).cast("int").alias("k"), F.col("b.c").alias("cosine"))
