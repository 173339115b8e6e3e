"""The prompt-conditioned view: prompt clusters against response-delta clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.features import cluster_mean, signed
from tessera.operators.welch import welch_grid


def c_scores(features: DataFrame, prompt_clusters: DataFrame, value: str = "freq") -> DataFrame:
    """row_idx, k, c: mean prompt activation over A_k(feature, k)."""
    return cluster_mean(features.where("side = 'P'"), prompt_clusters, F.col(value), "k").withColumnRenamed("x", "c")


def ru_scores(features: DataFrame, response_clusters: DataFrame, value: str = "freq") -> DataFrame:
    """row_idx, m, u: mean chosen minus rejected over R_m(feature, m)."""
    return cluster_mean(features.where("side IN ('C', 'R')"), response_clusters, signed(value), "m").withColumnRenamed("x", "u")


def top_expressers(c: DataFrame, examples: DataFrame, n_top: int = 200, require_active: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """k, row_idx, rank: the n_top rows of each prompt cluster by c, ties by row_idx; rows at 0 fill up unless
    require_active. Clusters are those of groups(k), or without it those with a cell.

    Only rows with a cell are ranked; zeros come from the n_top smallest row_idx without one, so no row x cluster grid
    is made.
    """
    w = Window.partitionBy("k").orderBy(F.desc(F.round("c", 9)), "row_idx")
    active = c.where("c > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_top).select("k", "row_idx", "rank")
    if require_active:
        return active
    ks = c.select("k").distinct() if groups is None else groups
    short = ks.join(c.where("c > 0").groupBy("k").agg(F.count(F.lit(1)).alias("have")), "k", "left").fillna(0, ["have"]).where(F.col("have") < n_top)
    first = examples.select("row_idx").orderBy("row_idx").limit(2 * n_top)  # have < n_top, so 2 n_top rows hold enough zeros
    zeros = short.crossJoin(F.broadcast(first)).join(c.where("c > 0").select("k", "row_idx"), ["k", "row_idx"], "left_anti")
    fill = zeros.withColumn("rank", F.col("have") + F.row_number().over(Window.partitionBy("k").orderBy("row_idx"))).where(F.col("rank") <= n_top).select("k", "row_idx", "rank")
    return active.unionByName(fill)


def hypotheses(features: DataFrame, examples: DataFrame, prompt_clusters: DataFrame, response_clusters: DataFrame, n: int, n_top: int = 200, value: str = "freq", require_active: bool = False) -> DataFrame:
    """(k, m, n_prompt_feats, n_resp_feats, u_in, u_out, delta, z_score, cohens_d), the full grid; empty when n_top < 5."""
    n_top = min(n_top, n // 2)
    top = top_expressers(c_scores(features, prompt_clusters, value), examples, n_top, require_active, prompt_clusters.select("k").distinct())
    size = examples.sparkSession.range(1).select(F.lit(n).alias("n_pool"), F.lit((n + 1) // 2).alias("n_even"), F.lit(n // 2).alias("n_odd"))
    grid = welch_grid(ru_scores(features, response_clusters, value), top.select("row_idx", "k"), size, measures=response_clusters.select("m").distinct())
    p, r = (df.groupBy(c).agg(F.count(F.lit(1)).cast("int").alias(a)) for df, c, a in ((prompt_clusters, "k", "n_prompt_feats"), (response_clusters, "m", "n_resp_feats")))
    out = grid.join(F.broadcast(p), "k").join(F.broadcast(r), "m").select("k", "m", "n_prompt_feats", "n_resp_feats", "u_in", "u_out", "delta", "z_score", "cohens_d")
    return out if n_top >= 5 else out.limit(0)


def prompt_scores(vector: DataFrame, prompt_clusters: DataFrame, hyps: DataFrame, top_k: int = 10, per_cluster: int = 2) -> DataFrame:
    """k, score, m, cohens_d, rank: live prompt features against A_k with each one's strongest hypotheses."""
    s = prompt_clusters.join(F.broadcast(vector), "feature", "left").fillna(0.0, ["act"]).groupBy("k").agg(F.avg("act").alias("score"))
    top = s.orderBy(F.desc("score"), "k").limit(top_k)
    w = Window.partitionBy("k").orderBy(F.desc(F.abs("cohens_d")), "m")
    best = hyps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_cluster).select("k", "m", "cohens_d", "rank")
    return top.join(best, "k", "left")
