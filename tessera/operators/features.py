"""Operators on the long activation table features(row_idx, side P/C/R, feature, max_act, freq). A missing cell is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.stats import exact_sum

RESPONSES = ("C", "R")


def signed(value: str | Column) -> Column:
    """+value for chosen, -value for rejected."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("side") == "C", value).when(F.col("side") == "R", -value).otherwise(F.lit(0.0))


def truncate_spans(tokens: DataFrame, prompt_max: int = 512, total_max: int = 1024) -> DataFrame:
    """tokens(row_idx, prompt array, response array, ...): prompts cut to prompt_max, responses to what total_max leaves."""
    cut = F.slice("prompt", 1, prompt_max)
    return tokens.withColumn("prompt", cut).withColumn("response", F.slice("response", F.lit(1), F.greatest(F.lit(0), F.lit(total_max) - F.size("prompt"))))


def pool(activations: DataFrame, lengths: DataFrame) -> DataFrame:
    """Span maximum and firing frequency of activations(row_idx, side, pos, feature, act).

    lengths(row_idx, side, n_tokens) is the denominator, so silent tokens count. Cells that never fire are left out.
    """
    fired = activations.where("act > 0").groupBy("row_idx", "side", "feature").agg(F.max("act").alias("max_act"), F.count(F.lit(1)).alias("n"))
    return fired.join(lengths, ["row_idx", "side"]).select("row_idx", "side", "feature", "max_act", (F.col("n") / F.col("n_tokens")).alias("freq"))


def delta(features: DataFrame) -> DataFrame:
    """row_idx, feature, d_max, d_freq: chosen minus rejected, cells of either side; one aggregation, no join."""
    return features.where(F.col("side").isin(*RESPONSES)).groupBy("row_idx", "feature").agg(F.sum(signed("max_act")).alias("d_max"), F.sum(signed("freq")).alias("d_freq"))


def product(features: DataFrame) -> DataFrame:
    """row_idx, feature, cr: chosen times rejected where both fire."""
    both = features.where(F.col("side").isin(*RESPONSES)).groupBy("row_idx", "feature").agg(F.max(F.when(F.col("side") == "C", F.col("freq"))).alias("c"), F.max(F.when(F.col("side") == "R", F.col("freq"))).alias("r"))
    return both.where("c IS NOT NULL AND r IS NOT NULL").select("row_idx", "feature", (F.col("c") * F.col("r")).alias("cr"))


def union_cells(features: DataFrame) -> DataFrame:
    """Distinct (row_idx, feature) that fire in either response."""
    return features.where(F.col("side").isin(*RESPONSES) & (F.col("freq") > 0)).select("row_idx", "feature").distinct()


def firing_probability(features: DataFrame, n: int | Column) -> DataFrame:
    """p1 of each feature over the 2N response streams."""
    return features.where(F.col("side").isin(*RESPONSES) & (F.col("freq") > 0)).groupBy("feature").agg(F.count(F.lit(1)).alias("n_fired")).withColumn("p1", F.col("n_fired") / (2 * F.lit(n)))


def union_probability(features: DataFrame, n: int) -> DataFrame:
    """Share of rows in which either response fires; rows are counted once by a two-step aggregation."""
    return union_cells(features).groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("union_p1", F.col("n_rows") / F.lit(n))


def inclusion_exclusion(features: DataFrame) -> DataFrame:
    """n_c, n_r, n_both and their union for each feature; equals union_probability * n."""
    cell = features.where(F.col("side").isin(*RESPONSES) & (F.col("freq") > 0)).groupBy("row_idx", "feature").agg(F.max((F.col("side") == "C").cast("long")).alias("c"), F.max((F.col("side") == "R").cast("long")).alias("r"))
    return cell.groupBy("feature").agg(F.sum("c").alias("n_c"), F.sum("r").alias("n_r"), F.sum(F.col("c") * F.col("r")).alias("n_both")).withColumn("n_union", F.col("n_c") + F.col("n_r") - F.col("n_both"))


def delta_moments(features: DataFrame, n: int, value: str = "freq") -> DataFrame:
    """feature, mean_d and population sigma_d of chosen minus rejected over all n rows, zeros included."""
    d = features.where(F.col("side").isin(*RESPONSES)).groupBy("row_idx", "feature").agg(F.sum(signed(value)).alias("d"))
    out = d.groupBy("feature").agg(exact_sum(F.col("d")).alias("s"), exact_sum(F.col("d") * F.col("d")).alias("q"))
    mean = F.col("s") / F.lit(n)
    return out.select("feature", mean.alias("mean_d"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.lit(n) - mean * mean)).alias("sigma_d"))


def retained(features: DataFrame, n: int, p_min: int = 200, r_min: int = 200, sigma_min: float = 1e-3, mean_min: float = 1e-4, value: str = "freq") -> DataFrame:
    """feature, p_count, r_count, mean_d, sigma_d, keep_prompt, keep_response; features with any cell."""
    p = features.where((F.col("side") == "P") & (F.col(value) > 0)).groupBy("feature").agg(F.count(F.lit(1)).alias("p_count"))
    r = union_cells(features).groupBy("feature").agg(F.count(F.lit(1)).alias("r_count"))
    out = p.join(r, "feature", "full_outer").join(delta_moments(features, n, value), "feature", "left").fillna(0, ["p_count", "r_count", "mean_d", "sigma_d"])
    p_min, r_min = max(2, p_min), max(2, r_min)
    return out.withColumn("keep_prompt", F.col("p_count") >= p_min).withColumn("keep_response", (F.col("r_count") >= r_min) & (F.col("sigma_d") >= sigma_min) & (F.abs("mean_d") >= mean_min))


def cluster_mean(features: DataFrame, clusters: DataFrame, side_value: Column, cluster: str) -> DataFrame:
    """row_idx, cluster, x: mean of side_value over the cluster's features; rows without a cell are left out (0)."""
    size = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return features.withColumn("__x", side_value).join(F.broadcast(clusters), "feature").groupBy("row_idx", cluster).agg(F.sum("__x").alias("__s")).join(F.broadcast(size), cluster).select("row_idx", cluster, (F.col("__s") / F.col("size")).alias("x"))


def firing_stats(features: DataFrame) -> DataFrame:
    """feature, n_examples, max_act, mean_act of chosen plus rejected maxima over rows where the sum is positive; total."""
    cell = features.where(F.col("side").isin(*RESPONSES)).groupBy("row_idx", "feature").agg(F.sum("max_act").alias("a")).where("a > 0")
    return cell.groupBy("feature").agg(F.count(F.lit(1)).alias("n_examples"), F.max("a").alias("max_act"), (exact_sum(F.col("a")) / F.count(F.lit(1))).alias("mean_act"), exact_sum(F.col("a")).alias("total"))
