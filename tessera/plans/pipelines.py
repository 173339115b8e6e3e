"""The composite views: feature-conditioned (B.1), prompt-conditioned (B.2), and the whole run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import communities as C, features as X, graph, primitives as P, prompt_view as V
from tessera.operators.welch import consistency, pool_size, welch_grid
from tessera.sources.storage import save, scratch


@dataclass(frozen=True)
class Config:
    """Parameters of a run; checked on creation."""

    tau: float = 0.01
    silent_percent: float = 5.0
    n_data_clusters: int = 8
    min_feature_cluster: int = 10
    min_data_cluster: int = 25
    weighted: bool = False
    min_p: float = 0.001
    top_percent: float = 1.0
    gamma: float = 1.0
    min_community: int = 4
    n_top: int = 200
    n_prompt_clusters: int = 8
    n_response_clusters: int = 8
    svd_rank: int = 16
    seed: int = 0

    def __post_init__(self):
        if not 0 <= self.silent_percent < 100 or not 0 < self.top_percent <= 100:
            raise ValueError("percentages must lie in 0..100")
        if min(self.n_data_clusters, self.min_community, self.min_feature_cluster, self.min_data_cluster, self.n_top, self.n_prompt_clusters, self.n_response_clusters, self.svd_rank) < 1 or self.tau < 0:
            raise ValueError("counts must be positive and tau not negative")
        if self.gamma <= 0 or not 0 <= self.min_p < 1:
            raise ValueError("gamma must be positive and min_p in 0..1")


def feature_view(scores: DataFrame, assignments: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Ranked (k, m) hypotheses from scores(row_idx, m, u, t_m) and assignments(row_idx, k; 0 = silent).

    The pool is the active rows. Order: delta_min descending, then k, m.
    """
    active = assignments.where("k > 0").select("row_idx", "k")
    values = scores.select("row_idx", "m", "u").join(active.select("row_idx"), "row_idx", "left_semi")
    grid = consistency(welch_grid(values, active, pool_size(active), split=True))
    size = scores.groupBy("m").agg(F.max("t_m").alias("t_m"))
    out = grid.join(F.broadcast(size), "m").where((F.col("t_m") >= cfg.min_feature_cluster) & (F.col("n_in") >= cfg.min_data_cluster) & F.col("sign_consistent"))
    return out.select("k", "m", F.col("n_in").alias("n_k"), "t_m", "u_in", "u_out", "delta", "z_score", "cohens_d", "delta_a", "delta_b", "sign_consistent", "delta_min", "is_chosen_leaning").orderBy(F.desc("delta_min"), "k", "m")


def data_clusters(scores: DataFrame, examples: DataFrame, cfg: Config = Config()) -> DataFrame:
    """assignments(row_idx, k): 0 for silent rows, else spherical k-means of the activity rows."""
    marked = P.silent(P.norms(scores, examples), cfg.silent_percent)
    active = marked.where("NOT silent AND s_norm > 0").select("row_idx")
    ms = [r["m"] for r in scores.select("m").distinct().orderBy("m").collect()]  # communities, not rows
    if not ms:
        return marked.select("row_idx", F.lit(0).alias("k"))
    rows = C.dense(scores.join(active, "row_idx", "left_semi").select("row_idx", "m", F.col("s").alias("x")), "row_idx", "m", ms)
    found = C.kmeans(rows, "row_idx", cfg.n_data_clusters, cfg.seed)
    return examples.select("row_idx").join(found, "row_idx", "left").fillna(0, ["k"])


def feature_clusters_of(cells: DataFrame, n_rows: int, k: int, cfg: Config, name: str) -> DataFrame:
    """(feature, name): k-means of the features' SVD embedding; cells(row_idx, feature, x)."""
    spark = cells.sparkSession
    sample = C.row_sample(cells.select("row_idx").distinct(), 30_000, cfg.seed)
    emb = C.svd_embedding(cells.join(sample, "row_idx", "left_semi"), cfg.svd_rank, n_rows)
    rows = spark.createDataFrame([(int(f), [float(v) for v in r]) for f, r in zip(emb.index, emb.to_numpy(), strict=True)], "feature int, x array<double>")
    return C.kmeans(rows, "feature", k, cfg.seed).select("feature", F.col("k").cast("int").alias(name))


def run(spark: SparkSession, features: DataFrame, examples: DataFrame, cfg: Config = Config()) -> dict[str, DataFrame]:
    """Everything from an activation table: edges, clusters, scores, assignments, both hypothesis tables and a summary."""
    features = save(features, scratch(spark, "run-features"), "side", "feature")
    n = examples.count()
    edges = save(graph.edges(graph.mi_pairs(features, n, cfg.min_p), cfg.top_percent), scratch(spark, "run-edges"))
    clusters = save(C.communities(edges, cfg.gamma, cfg.min_community, cfg.seed), scratch(spark, "run-clusters"))
    scores = save(P.scores(features, clusters, cfg.tau, cfg.weighted), scratch(spark, "run-scores"))
    assignments = save(data_clusters(scores, examples, cfg), scratch(spark, "run-assignments"))
    b1 = save(feature_view(scores, assignments, cfg), scratch(spark, "run-b1"))
    keep = X.retained(features, n)
    p = features.where("side = 'P'").join(F.broadcast(keep.where("keep_prompt").select("feature")), "feature", "left_semi").select("row_idx", "feature", F.col("freq").alias("x"))
    r = X.delta(features).join(F.broadcast(keep.where("keep_response").select("feature")), "feature", "left_semi").select("row_idx", "feature", F.col("d_freq").alias("x"))
    some = p.select("feature").distinct().limit(2).count() == 2 and r.select("feature").distinct().limit(2).count() == 2
    if some:
        pc, rc = feature_clusters_of(p, n, cfg.n_prompt_clusters, cfg, "k"), feature_clusters_of(r, n, cfg.n_response_clusters, cfg, "m")
        b2 = V.hypotheses(features, examples, save(pc, scratch(spark, "run-pc")), save(rc, scratch(spark, "run-rc")), n, cfg.n_top).orderBy(F.desc(F.abs("z_score")), "k", "m")
    else:
        b2 = spark.createDataFrame([], "k int, m int, n_prompt_feats int, n_resp_feats int, u_in double, u_out double, delta double, z_score double, cohens_d double")
    b2 = save(b2, scratch(spark, "run-b2"))
    summary = spark.range(1).select(F.lit(n).alias("num_examples"), F.lit(clusters.select("m").distinct().count()).alias("num_feature_clusters"), F.lit(b1.count()).alias("num_b1"), F.lit(b2.count()).alias("num_b2"))
    return {"edges": edges, "clusters": clusters, "scores": scores, "assignments": assignments, "b1": b1, "b2": b2, "summary": summary}
