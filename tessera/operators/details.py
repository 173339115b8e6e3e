"""Cluster details, validation universes and run listings: the remaining interactive and offline queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.stats import corr
from tessera.operators import explore as E
from tessera.operators.features import RESPONSES


def binarize(features: DataFrame, tau: float = 0.01) -> DataFrame:
    """features with fired: 1 where freq > tau."""
    return features.withColumn("fired", (F.col("freq") > tau).cast("int"))


def member_subset(features: DataFrame, clusters: DataFrame, min_size: int = 4) -> DataFrame:
    """Cells of features in a community of min_size or more; the filter joins before any shuffle where it is small."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    return features.join(clusters.join(size.select("m"), "m", "left_semi").select("feature"), "feature", "left_semi")


def top_members(features: DataFrame, clusters: DataFrame, n: int = 8) -> DataFrame:
    """m, feature, total, rank: members by summed response maxima."""
    total = features.where(F.col("side").isin(*RESPONSES)).groupBy("feature").agg(F.sum("max_act").alias("total"))
    return E.top_per(clusters.join(total, "feature"), "m", [F.desc(F.round("total", 6)), F.col("feature")], n).select("m", "feature", "total", "rank")


def direction_counts(scores: DataFrame) -> DataFrame:
    """m, n_amplify, n_suppress."""
    return scores.groupBy("m").agg(F.count_if(F.col("u") > 0).alias("n_amplify"), F.count_if(F.col("u") < 0).alias("n_suppress"))


def activation_examples(features: DataFrame, clusters: DataFrame, m: int, n: int = 12) -> DataFrame:
    """row_idx, act: rows by the summed response maxima of a community's members, those above 0."""
    own = features.where(F.col("side").isin(*RESPONSES)).join(F.broadcast(clusters.where(F.col("m") == m).select("feature")), "feature", "left_semi")
    return own.groupBy("row_idx").agg(F.sum("max_act").alias("act")).where("act > 0").orderBy(F.desc(F.round("act", 6)), "row_idx").limit(n)


def exemplars(values: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """key, row_idx, rank: the n rows with the largest value of each key."""
    return E.top_per(values.withColumn("__v", F.round(value, 9)), key, [F.desc("__v"), F.col("row_idx")], n).select(key, "row_idx", "rank")


def cluster_detail(kind: str, cluster: int, features: DataFrame, clusters: DataFrame, assignments: DataFrame, hypotheses: DataFrame, n: int = 10) -> DataFrame:
    """Rows (section, a, b, x): members and hypotheses of a cluster of any family (B or T by their tables)."""
    if E.family(kind) not in ("B", "T"):
        raise ValueError(f"clusters of family {E.family(kind)} have no hypotheses here")
    if E.family(kind) == "B":
        own = assignments.where(F.col("k") == cluster)
        head = own.select(F.lit("size").alias("section"), "row_idx").groupBy("section").agg(F.count(F.lit(1)).alias("b")).select("section", F.lit(cluster).cast("long").alias("a"), "b", F.lit(0.0).alias("x"))
        hyp = hypotheses.where(F.col("k") == cluster).orderBy(F.desc(F.abs("delta")), "m").limit(n).select(F.lit("hypothesis").alias("section"), F.col("k").cast("long").alias("a"), F.col("m").cast("long").alias("b"), F.col("delta").alias("x"))
        return head.unionByName(hyp)
    top = top_members(features, clusters.where(F.col("m") == cluster), n).select(F.lit("member").alias("section"), F.col("m").cast("long").alias("a"), F.col("feature").cast("long").alias("b"), F.col("total").alias("x"))
    hyp = hypotheses.where(F.col("m") == cluster).orderBy(F.desc(F.abs("delta")), "k").limit(n).select(F.lit("hypothesis").alias("section"), F.col("m").cast("long").alias("a"), F.col("k").cast("long").alias("b"), F.col("delta").alias("x"))
    return top.unionByName(hyp)


def validation_universe(u_bar: DataFrame, valid: DataFrame, n: int) -> DataFrame:
    """m, u_bar, rank: valid communities by |u_bar|, the first n."""
    ok = u_bar.join(F.broadcast(valid.select("m")), "m", "left_semi")
    return ok.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("u_bar"), 9)), "m"))).where(F.col("rank") <= n)  # one row a community


def cluster_means(vector: DataFrame, clusters: DataFrame) -> DataFrame:
    """m, mean of vector(feature, x) over the members that it has; null without one."""
    return clusters.join(vector, "feature", "left").groupBy("m").agg(F.avg("x").alias("mean"))


def cluster_validation(vector: DataFrame, clusters: DataFrame, min_members: int = 4) -> DataFrame:
    """m, n_features, predicted_sum, observed_sum, predicted_mean, observed_mean of the communities with min_members members in
    vector(feature, x, y) or more; and, the same in every row, pearson_r and r2 of the sums across these communities (both 0
    for fewer than three; r2 is 0 where r is undefined)."""
    v = clusters.join(vector.where("x IS NOT NULL AND y IS NOT NULL"), "feature")
    each = v.groupBy("m").agg(F.count(F.lit(1)).alias("n_features"), F.sum("x").alias("predicted_sum"), F.sum("y").alias("observed_sum"), F.avg("x").alias("predicted_mean"), F.avg("y").alias("observed_mean")).where(F.col("n_features") >= min_members)
    r = each.agg(F.count(F.lit(1)).alias("c"), corr("predicted_sum", "observed_sum").alias("r"))
    r = r.select(F.when(F.col("c") > 2, F.col("r")).otherwise(0.0).alias("pearson_r")).withColumn("r2", F.coalesce(F.nanvl(F.col("pearson_r") * F.col("pearson_r"), F.lit(0.0)), F.lit(0.0)))
    return each.crossJoin(F.broadcast(r))  # one row


def run_summary(hypotheses: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n hypotheses with the number of all."""
    total = hypotheses.agg(F.count(F.lit(1)).alias("n_all"))
    return hypotheses.orderBy(*order).limit(n).crossJoin(F.broadcast(total))


def family_counts(catalog: DataFrame) -> DataFrame:
    """family, n with the grand total under null: the counts all / B / T / A / R."""
    return catalog.rollup("family").agg(F.count(F.lit(1)).alias("n"))


def with_fallback(main: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """main's values, and other's for keys that main lacks or has null or empty (an empty string, list or map)."""
    kind = main.schema[value].dataType
    empty = F.size("__a") == 0 if isinstance(kind, (T.ArrayType, T.MapType)) else F.col("__a") == "" if isinstance(kind, T.StringType) else F.lit(False)
    both = main.select(key, F.col(value).alias("__a")).join(other.select(key, F.col(value).alias("__b")), key, "full_outer")
    return both.select(key, F.coalesce(F.when(~empty, F.col("__a")), "__b", "__a").alias(value))
