"""Interactive queries: live signals, inverse search, cluster and feature details. All return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.features import RESPONSES, firing_stats


def parse_conditions(text: str, default: float = 0.01) -> list[tuple[int, str, float]]:
    """'m:direction[:threshold],...'. A part without a direction or with a bad m is skipped, a bad direction is amplify, a bad
    threshold the default."""
    out = []
    for part in (text or "").split(","):
        m, *bits = (b.strip() for b in part.split(":"))
        if not bits:
            continue
        try:
            number = int(m)
        except ValueError:
            continue
        try:
            threshold = float(bits[1]) if bits[1:] and bits[1] else default
        except ValueError:
            threshold = default
        out.append((number, bits[0] if bits[0] == "suppress" else "amplify", threshold))
    return out


def cluster_signals(vector: DataFrame, clusters: DataFrame, d: int, mode: str = "sum") -> DataFrame:
    """m, signal: sum or mean of vector(feature, act) over the cluster's features below d; empty clusters: 0.

    An empty vector gives an empty result.
    """
    inside = clusters.where((F.col("feature") >= 0) & (F.col("feature") < d)).join(F.broadcast(vector), "feature", "left").fillna(0.0, ["act"])
    got = inside.groupBy("m").agg((F.sum if mode == "sum" else F.avg)("act").alias("signal"))
    out = clusters.select("m").distinct().join(got, "m", "left").fillna(0.0, ["signal"])
    return out.join(F.broadcast(vector.limit(1).select(F.lit(1).alias("__any"))), how="left_semi")


def live_pair(vector_c: DataFrame, vector_r: DataFrame, tau: float = 0.01) -> DataFrame:
    """feature, act: 1 if chosen fires, less 1 if rejected fires, by the maximum over the whole text."""
    both = vector_c.select("feature", F.col("act").alias("c")).join(vector_r.select("feature", F.col("act").alias("r")), "feature", "full_outer").fillna(0.0)
    return both.select("feature", ((F.col("c") > tau).cast("int") - (F.col("r") > tau).cast("int")).cast("double").alias("act"))


def evidence(hypotheses: DataFrame, signals: DataFrame) -> DataFrame:
    """hypotheses with evidence = |delta| * |signal of m|; no signal or no delta: 0."""
    return hypotheses.join(F.broadcast(signals), "m", "left").withColumn("evidence", F.coalesce(F.abs("delta") * F.abs("signal"), F.lit(0.0))).drop("signal")


def score_data_clusters(with_evidence: DataFrame) -> DataFrame:
    """k, relevance (the best evidence), best_m: clusters with any evidence, the most relevant first; ties: smaller m, smaller k."""
    best = F.max(F.struct(F.col("evidence").alias("e"), (-F.col("m")).alias("m")))
    out = with_evidence.groupBy("k").agg(best.alias("b")).where("b.e > 0")
    return out.select("k", F.col("b.e").alias("relevance"), (-F.col("b.m")).cast("int").alias("best_m")).orderBy(F.desc("relevance"), "k")


def top_per(df: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1. The window cuts groups before the shuffle where Spark can."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def enrich(df: DataFrame, labels: DataFrame, key: str = "m", prefix: str = "T_") -> DataFrame:
    """df with title from labels(key, title); without one: prefix and the key."""
    return df.join(F.broadcast(labels.select(key, "title")), key, "left").withColumn("title", F.coalesce("title", F.concat(F.lit(prefix), F.col(key).cast("string"))))


def predicted_shifts(hypotheses: DataFrame, signals: DataFrame, labels: DataFrame, limit: int = 10, per_cluster: int = 2) -> DataFrame:
    """The strongest shifts: two hypotheses a data cluster by evidence, then the first `limit` of all."""
    e = evidence(hypotheses, signals).where("evidence > 0")
    top = top_per(e, "k", [F.desc("evidence"), F.col("m")], per_cluster)
    return enrich(top.orderBy(F.desc("evidence"), "k", "m").limit(limit), labels).withColumn("direction", F.when(F.col("delta") > 0, "amplified").otherwise("suppressed"))


def best_by_measure(hypotheses: DataFrame) -> DataFrame:
    """For each m the hypothesis with the largest |delta|; ties: smaller k."""
    return top_per(hypotheses, "m", [F.desc(F.abs("delta")), F.col("k")], 1).drop("rank")


def pair_concepts(signals: DataFrame, best: DataFrame, clusters: DataFrame, labels: DataFrame, min_size: int = 1, n: int = 5) -> DataFrame:
    """side, m, signal, k, strength, title: the n most promoted and the n most suppressed concepts that have a hypothesis."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("t_m")).where(F.col("t_m") >= min_size)
    s = signals.where("signal <> 0").join(F.broadcast(size.select("m")), "m", "left_semi").join(F.broadcast(best.select("m", "k")), "m")
    strength = F.when(F.abs("signal") > 0.15, "Strong").when(F.abs("signal") > 0.05, "Moderate").otherwise("Weak")
    s = enrich(s.withColumn("side", F.when(F.col("signal") > 0, "promoted").otherwise("suppressed")).withColumn("strength", strength), labels)
    return top_per(s, "side", [F.desc(F.abs("signal")), F.col("m")], n)


def rank_samples(scores: DataFrame, m: int, side: str = "amplify", top_n: int = 12) -> tuple[DataFrame, DataFrame]:
    """The top rows of a community by disparity in one direction, and how many rows match in all."""
    hit = scores.where((F.col("m") == m) & ((F.col("u") > 0) if side == "amplify" else (F.col("u") < 0)))
    order = F.desc("u") if side == "amplify" else F.asc("u")
    return hit.orderBy(order, "row_idx").limit(min(200, max(1, top_n))), hit.agg(F.count(F.lit(1)).alias("total_matching"))


def rank_compound(scores: DataFrame, conditions: list[tuple[int, str, float]], known: set[int], top_n: int = 12, strict: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """row_idx, score: rows where every known condition's direction holds, by the sum of |u|. Thresholds are not applied.

    Conditions on unknown communities are ignored; if none is known every example of `rows` (without it, every row with a
    score) matches with 0 (an error if strict).
    """
    wanted = sorted({(m, d) for m, d, _ in conditions if m in known})
    if not wanted:
        if strict:
            raise ValueError("no condition names a known community")
        all_rows = scores.select("row_idx").distinct() if rows is None else rows
        return all_rows.select("row_idx", F.lit(0.0).alias("score")).orderBy("row_idx").limit(top_n)
    match = F.lit(False)
    for m, d in wanted:
        match = match | ((F.col("m") == m) & ((F.col("u") > 0) if d == "amplify" else (F.col("u") < 0)))
    hit = scores.where(F.col("m").isin(*(m for m, _ in wanted)) & match).groupBy("row_idx").agg(F.count(F.lit(1)).alias("c"), F.sum(F.abs("u")).alias("score"))
    return hit.where(F.col("c") == len(wanted)).orderBy(F.desc("score"), "row_idx").limit(top_n).select("row_idx", "score")


def member_firing(features: DataFrame, rows: DataFrame, members: DataFrame, n: int = 20) -> DataFrame:
    """row_idx, feature, c_freq, r_freq, active_in, rank: the samples' firing members by chosen plus rejected, top n."""
    f = features.where(F.col("side").isin(*RESPONSES)).join(F.broadcast(members.select("feature")), "feature", "left_semi").join(rows.select("row_idx"), "row_idx", "left_semi")
    one = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("freq"))), F.lit(0.0))
    g = f.groupBy("row_idx", "feature").agg(one("C").alias("c_freq"), one("R").alias("r_freq"))
    g = g.withColumn("active_in", F.when((F.col("c_freq") > 0) & (F.col("r_freq") > 0), "both").when(F.col("c_freq") > 0, "chosen").otherwise("rejected"))
    return top_per(g, "row_idx", [F.desc(F.round(F.col("c_freq") + F.col("r_freq"), 9)), F.col("feature")], n)


def top_examples(scores: DataFrame, examples: DataFrame, n: int = 5, value: str = "score") -> DataFrame:
    """The n best rows, then only those above 0, with their texts."""
    return scores.orderBy(F.desc(value), "row_idx").limit(n).where(F.col(value) > 0).join(examples, "row_idx")


def top_features(vector: DataFrame, clusters: DataFrame, min_size: int = 4, n: int = 8) -> DataFrame:
    """feature, act, parent: the n strongest live features; parent only for communities of min_size or more."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("t_m"))
    parent = clusters.join(F.broadcast(size), "m").select("feature", F.when(F.col("t_m") >= min_size, F.col("m")).alias("parent"))
    return vector.where("act > 0").orderBy(F.desc("act"), "feature").limit(n).join(F.broadcast(parent), "feature", "left")


def cluster_keywords(vector: DataFrame, clusters: DataFrame, n: int = 3) -> DataFrame:
    """m, keywords: the n strongest live features of each community, as text."""
    hit = top_per(clusters.join(F.broadcast(vector.where("act > 0")), "feature"), "m", [F.desc("act"), F.col("feature")], n)
    text = F.format_string("SAE-Feat_%d (act=%.2f)", F.col("feature"), F.col("act"))
    return hit.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("k")).select("m", F.transform("k", lambda x: x["t"]).alias("keywords"))


def feature_detail(features: DataFrame, feature: int, clusters: DataFrame, min_size: int = 4) -> DataFrame:
    """One row: firing statistics of a feature and its parent community. The filter reaches the scan."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("t_m"))
    parent = clusters.where(F.col("feature") == feature).join(size, "m").select("feature", F.when(F.col("t_m") >= min_size, F.col("m")).alias("parent"))
    return firing_stats(features.where(F.col("feature") == feature)).join(parent, "feature", "left")


def covered(hypotheses: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """The first n hypotheses of every response cluster in rank order."""
    return top_per(hypotheses, "m", [F.col(rank)], n, "place")


FAMILIES = {"data": "B", "b": "B", "bk": "B", "feature": "T", "t": "T", "tm": "T", "prompt": "A", "a": "A", "ak": "A", "response": "R", "r": "R", "rm": "R"}


def family(name: str) -> str:
    """B, T, A or R from any of a cluster family's names."""
    return FAMILIES[name.strip().lower()]


def catalog(*parts: DataFrame) -> DataFrame:
    """Union of cluster lists (key, src, ...): of equal keys the first source stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per(out, "key", [F.col("src")], 1).drop("rank")


def search(labels: DataFrame, text: str) -> DataFrame:
    """Labels whose key, title, description or keywords contain the text, in any case."""
    q = F.lit((text or "").lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return labels.where(has(F.col("key")) | has(F.col("title")) | has(F.col("description")) | F.coalesce(F.exists("keywords", lambda k: F.contains(F.lower(k), q)), F.lit(False)))
