"""Coverage deficits, sufficiency, cluster audits, prediction validation, interventions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.stats import cohens_d, corr, slope, welch_z

MODES = {"amp_sup": ("amp", "sup"), "amp_amp": ("amp", "amp"), "sup_sup": ("sup", "sup"), "amp_neutral": ("amp", "neutral")}


def directions(scores: DataFrame, tau: float = 0.08) -> DataFrame:
    """row_idx, m, dir: amp (u > tau), sup (u < -tau) or neutral, of cells with s > 0."""
    return scores.where("s > 0").select("row_idx", "m", F.when(F.col("u") > tau, "amp").when(F.col("u") < -tau, "sup").otherwise("neutral").alias("dir"))


def deficits(scores: DataFrame, tau: float = 0.08, modes: dict = MODES) -> DataFrame:
    """mode, a, b, demand_a, demand_b, joint for all ordered pairs of communities and every mode, zero counts included.

    A row's cells join on the row, so pairs grow with the square of the communities active in one row, not of the rows.
    """
    d = directions(scores, tau)
    joint = d.select("row_idx", F.col("m").alias("a"), F.col("dir").alias("da")).join(d.select("row_idx", F.col("m").alias("b"), F.col("dir").alias("db")), "row_idx").where("a <> b").groupBy("a", "b", "da", "db").agg(F.count(F.lit(1)).alias("joint"))
    demand = d.groupBy("m", "dir").agg(F.count(F.lit(1)).alias("n"))
    ms = d.select("m").distinct()
    grid = ms.withColumnRenamed("m", "a").join(ms.withColumnRenamed("m", "b"), F.col("a") != F.col("b"))  # communities squared: the output
    out = None
    for mode, (x, y) in modes.items():
        part = grid.withColumn("mode", F.lit(mode)).join(joint.where((F.col("da") == x) & (F.col("db") == y)).select("a", "b", "joint"), ["a", "b"], "left")
        part = part.join(F.broadcast(demand.where(F.col("dir") == x).select(F.col("m").alias("a"), F.col("n").alias("demand_a"))), "a", "left").join(F.broadcast(demand.where(F.col("dir") == y).select(F.col("m").alias("b"), F.col("n").alias("demand_b"))), "b", "left")
        part = part.fillna(0, ["joint", "demand_a", "demand_b"]).select("mode", "a", "b", "demand_a", "demand_b", "joint")
        out = part if out is None else out.unionByName(part)
    return out


def bottlenecks(deficits_: DataFrame, demand_a: int = 200, demand_b: int = 50, most: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """Pairs in demand with few joint examples, the fewest and then the most wanted first: joint_ratio (of a's demand),
    severity, and titles from labels(m, title), T_m without one."""
    severity = F.when(F.col("joint") == 0, "Critical Zero").when(F.col("joint") <= 3, "Severe Deficit").otherwise("Moderate Deficit")
    out = deficits_.where((F.col("demand_a") >= demand_a) & (F.col("demand_b") >= demand_b) & (F.col("joint") <= most))
    out = out.withColumn("joint_ratio", F.col("joint") / F.greatest(F.lit(1), F.col("demand_a"))).withColumn("severity", severity)
    for x in "ab":
        named = F.concat(F.lit("T_"), F.col(x).cast("string"))
        if labels is not None:
            out = out.join(labels.select(F.col("m").alias(x), F.col("title").alias(f"title_{x}")), x, "left")
            named = F.coalesce(f"title_{x}", named)
        out = out.withColumn(f"title_{x}", named)
    return out.orderBy("joint", F.desc("demand_a"), "mode", "a", "b")


def scan_summary(deficits_: DataFrame) -> DataFrame:
    """mode, n_pairs and how many have 0, at most 5, at most 10 joint examples."""
    c = lambda x: F.count_if(x)
    return deficits_.groupBy("mode").agg(F.count(F.lit(1)).alias("n_pairs"), c(F.col("joint") == 0).alias("n_zero"), c(F.col("joint") <= 5).alias("n_le5"), c(F.col("joint") <= 10).alias("n_le10"))


def latent_coverage(features: DataFrame, rows: DataFrame, members: DataFrame, tau: float = 0.08) -> DataFrame:
    """One row: n_members, n_covered (chosen maximum over the rows above tau), coverage."""
    top = features.where("side = 'C'").join(F.broadcast(members.select("feature")), "feature", "left_semi").join(rows.select("row_idx"), "row_idx", "left_semi").groupBy("feature").agg(F.max("max_act").alias("a"))
    return members.select("feature").join(top, "feature", "left").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.coalesce("a", F.lit(0.0)) > tau).alias("n_covered")).withColumn("coverage", F.col("n_covered") / F.greatest(F.lit(1), F.col("n_members")))


def sufficiency(counts: DataFrame, population: int = 260_000, samples: int = 64) -> DataFrame:
    """counts(n, n_features, n_active, mean_in, mean_out, var_in, var_out, n_out) with coverage_pct, dead_count, rank_bound,
    batch_visibility_pct, welch_z, risk_score, recommended_quota and verdict.

    n: matching examples, null where the community has no scores (UNINDEXED). n_active: members that fire in them. A z value
    needs two examples; the inside variance is at least the outside one and the standard error at least 1e-6.
    """
    n, share = F.coalesce("n", F.lit(0)), F.coalesce(F.col("n_active"), F.lit(0)) / F.greatest(F.lit(1), F.col("n_features"))
    active = F.coalesce(F.col("n_active"), F.lit(0))
    se = F.sqrt(F.greatest("var_in", "var_out") / n + F.col("var_out") / F.greatest(F.lit(1), F.col("n_out")))
    quota = F.greatest(F.lit(150), F.floor(F.col("n_features") * 8.5).cast("int"))
    verdict = F.when(F.col("n").isNull(), "UNINDEXED").when((n <= 3) | (share < 0.25), "CRITICAL").when((n < 30) | (share < 0.75), "DEFICIENT").otherwise("SUFFICIENT")
    return counts.select(
        "*", (100 * share).alias("coverage_pct"), (F.col("n_features") - active).alias("dead_count"), F.least(n, active).alias("rank_bound"),
        F.least(F.lit(100.0), 100 * (1 - F.pow(1 - n / F.lit(float(population)), F.lit(float(samples))))).alias("batch_visibility_pct"),
        F.when(n > 1, (F.col("mean_in") - F.col("mean_out")) / F.greatest(F.lit(1e-6), se)).otherwise(0.0).alias("welch_z"),
        (100 * (1 - share) * F.exp(-n / 50.0)).alias("risk_score"), F.when(F.col("n").isNull() | (share < 0.95), quota).otherwise(0).alias("recommended_quota"), verdict.alias("verdict"),
    )


def dead_features(features: DataFrame, rows: DataFrame, members: DataFrame, tau: float = 0.08) -> DataFrame:
    """m, feature: members(m, feature) whose chosen maximum over the rows isn't above tau."""
    top = features.where("side = 'C'").join(rows.select("row_idx"), "row_idx", "left_semi").groupBy("feature").agg(F.max("max_act").alias("a")).where(F.col("a") > tau)
    return members.select("m", "feature").join(top, "feature", "left_anti").select("m", "feature")


def global_disparity(features: DataFrame, clusters: DataFrame, rows: DataFrame, tau: float = 0.01) -> DataFrame:
    """m, u_bar: mean over the community of P(chosen fires) - P(rejected fires) on the given rows (two steps)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    f = features.where("side IN ('C', 'R')").join(rows.select("row_idx"), "row_idx", "left_semi").where(F.col("freq") > tau)
    per = f.groupBy("feature").agg(F.sum(F.when(F.col("side") == "C", 1).otherwise(-1)).alias("net"))
    per = clusters.join(per, "feature", "left").fillna(0, ["net"]).crossJoin(F.broadcast(n))
    return per.groupBy("m").agg((F.sum("net") / F.max("n") / F.count(F.lit(1))).alias("u_bar"))


def validation(pairs: DataFrame) -> DataFrame:
    """One row: n, slope, intercept, r2, pearson_r of pairs(x, y); rows with a null or NaN are left out; n < 2: zeros."""
    ok = pairs.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    fit = ok.agg(F.count(F.lit(1)).alias("n"), z(slope("x", "y")).alias("slope"), z(corr("x", "y")).alias("pearson_r"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    some = lambda c: F.when(F.col("n") >= 2, c).otherwise(F.lit(0.0))
    return fit.select("n", some(F.col("slope")).alias("slope"), some(F.col("ay") - F.col("slope") * F.col("ax")).alias("intercept"), some(F.col("pearson_r") * F.col("pearson_r")).alias("r2"), some(F.col("pearson_r")).alias("pearson_r"))


def p_value(r: float, n: int) -> float:
    """Two-sided p of a Pearson correlation: the incomplete beta function by its continued fraction."""
    if n < 3:
        return 1.0
    x = max(0.0, 1 - r * r)
    if x == 0:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        t = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with ranks from 1, tied values sharing their mean. For validation tables (one row a community)."""
    w = Window.orderBy(column)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(column)) - 1) / 2.0)


def spearman(pairs: DataFrame) -> DataFrame:
    ranked = average_rank(average_rank(pairs.where("x IS NOT NULL AND y IS NOT NULL"), "x", "rx"), "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), corr("rx", "ry").alias("spearman_r"))


def sign_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.when(F.signum("x") == F.signum("y"), 1.0).otherwise(0.0)).alias("sign_agreement"))


def top_k_validation(pairs: DataFrame, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """k, n, pearson_r, r2 over the k rows with the largest |x|; pairs(id, x, y)."""
    ranked = pairs.withColumn("rk", F.row_number().over(Window.orderBy(F.desc(F.abs("x")), "id")))
    cut = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    r = ranked.join(F.broadcast(cut), F.col("rk") <= F.col("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), corr("x", "y").alias("r"))
    return r.select("k", "n", F.when(F.col("n") >= 2, F.col("r")).alias("pearson_r"), F.when(F.col("n") >= 2, F.col("r") * F.col("r")).alias("r2"))


def _shuffled(name: str, *salt) -> Column:
    """The place, from 0, of each row of a replicate in an order of hashes."""
    return F.row_number().over(Window.partitionBy("rep").orderBy(F.md5(F.concat_ws(":", *map(F.lit, salt), "rep", name)), name)) - 1


def replicates(pairs: DataFrame, n: int, seed: int = 0, kind: str = "permutation", paired: bool = False, k: int = 50) -> DataFrame:
    """rep, r: correlations under n seeded replicates of pairs(id, x, y), ids dense from 0.

    permutation: y against a shuffled order. bootstrap: x and y drawn with replacement, each with its own draws unless
    paired. subsets: the x of k pairs against the y of k others, both drawn without replacement from all. Draws are hashes
    of (seed, salt, rep, place), so they don't depend on partitioning.
    """
    size = pairs.agg(F.count(F.lit(1)).alias("size"))
    reps = pairs.sparkSession.range(n).withColumnRenamed("id", "rep")
    place = pairs.select(F.col("id").alias("i")).crossJoin(F.broadcast(size)).crossJoin(reps)  # replicates x pairs
    if kind == "permutation":
        other = place.withColumn("j", _shuffled("i", seed)).withColumn("i2", F.col("i"))
    elif kind == "bootstrap":
        draw = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), "rep", "i")), 1, 8), 16, 10).cast("long"), F.col("size"))
        other = place.withColumn("i2", draw(1)).withColumn("j", F.col("i2") if paired else draw(2))
    else:
        some = lambda name, salt: place.withColumn("at", _shuffled("i", seed, salt)).where(F.col("at") < k).select("rep", "at", F.col("i").alias(name))
        other = some("i2", 1).join(some("j", 2), ["rep", "at"])
    x, y = pairs.select(F.col("id").alias("i2"), "x"), pairs.select(F.col("id").alias("j"), "y")
    return other.join(x, "i2").join(y, "j").groupBy("rep").agg(corr("x", "y").alias("r"))


def permutation_p(pairs: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """One row: p = (1 + replicates with |r| at least the observed) / (n + 1)."""
    seen = pairs.agg(corr("x", "y").alias("r0"))
    return replicates(pairs, n, seed).crossJoin(F.broadcast(seen)).agg(((F.count_if(F.abs("r") >= F.abs("r0") - 1e-12) + 1) / (n + 1)).alias("p_perm"))


def bootstrap_ci(pairs: DataFrame, n: int = 1000, seed: int = 0, paired: bool = False) -> DataFrame:
    """lo, hi: the 95 % interval of r squared."""
    r2 = F.col("r") * F.col("r")
    return replicates(pairs, n, seed, "bootstrap", paired).agg(F.percentile(r2, 0.025).alias("lo"), F.percentile(r2, 0.975).alias("hi"))


def negative_control(pairs: DataFrame, n: int = 1000, seed: int = 0, k: int = 50) -> DataFrame:
    """Mean and 95th percentile of r squared between two independent subsets of k of all pairs, without replacement."""
    r2 = F.col("r") * F.col("r")
    return replicates(pairs, n, seed + 1, "subsets", False, k).agg(F.avg(r2).alias("mean_r2"), F.percentile(r2, 0.95).alias("p95_r2"))


def size_audit(clusters: DataFrame) -> DataFrame:
    """One row: count, min, max, mean, median of community sizes, and how many exceed twice the median."""
    s = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    a = s.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"))
    return s.crossJoin(F.broadcast(a)).groupBy(*a.columns).agg(F.count_if(F.col("size") > 2 * F.col("median_size")).alias("n_large"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    s = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    c = F.col("size")
    return s.groupBy(F.when(c < 5, "<5").when(c < 10, "5-9").when(c < 20, "10-19").when(c < 50, "20-49").when(c < 100, "50-99").otherwise("100+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def s_versus_u(scores: DataFrame, n: int, top: int = 5) -> DataFrame:
    """m, corr over all n rows (absent = 0), n_zero_u, overlap of the top rows by s and by |u|."""
    c = F.col
    g = scores.groupBy("m").agg(F.sum("s").alias("ss"), F.sum("u").alias("su"), F.sum(c("s") * c("s")).alias("qs"), F.sum(c("u") * c("u")).alias("qu"), F.sum(c("s") * c("u")).alias("su2"), F.count_if(c("u") != 0).alias("nz"))
    cov, vs, vu = n * c("su2") - c("ss") * c("su"), n * c("qs") - c("ss") * c("ss"), n * c("qu") - c("su") * c("su")
    w = lambda o: Window.partitionBy("m").orderBy(o, "row_idx")
    both = scores.withColumn("rs", F.row_number().over(w(F.desc(F.round("s", 9))))).withColumn("ru", F.row_number().over(w(F.desc(F.round(F.abs("u"), 9))))).groupBy("m").agg(F.count_if((c("rs") <= top) & (c("ru") <= top)).alias("overlap"))
    return g.join(both, "m").select("m", F.when((vs > 0) & (vu > 0), cov / F.sqrt(vs * vu)).otherwise(0.0).alias("corr"), (F.lit(n) - c("nz")).alias("n_zero_u"), "overlap")


def purge(rows: DataFrame, assignments: DataFrame, ks: list[int]) -> DataFrame:
    """rows without those of the purged data clusters."""
    return rows.join(assignments.where(F.col("k").isin(*ks)).select("row_idx"), "row_idx", "left_anti")


def loss_weights(scores: DataFrame, rows: DataFrame, m: int, temperature: float = 1.0) -> DataFrame:
    """row_idx, weight = sigmoid(u / temperature) of community m; rows without a cell: 0.5."""
    return rows.select("row_idx").join(scores.where(F.col("m") == m).select("row_idx", "u"), "row_idx", "left").select("row_idx", (1 / (1 + F.exp(-F.coalesce("u", F.lit(0.0)) / temperature))).alias("weight"))


def steering_vector(decoder: DataFrame, scales: DataFrame) -> DataFrame:
    """dim, value: sum of scale * decoder(feature, weights array) over scales(feature, scale), divided by its norm."""
    total = decoder.join(F.broadcast(scales), "feature").select("scale", F.posexplode("weights").alias("dim", "w")).groupBy("dim").agg(F.sum(F.col("scale") * F.col("w")).alias("v"))
    norm = total.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return total.crossJoin(F.broadcast(norm)).select("dim", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(F.col("v")).alias("value"))


def reward_margin(logps: DataFrame) -> DataFrame:
    """One row: n, mean and population deviation of logp_c - logp_r."""
    d = F.col("logp_c") - F.col("logp_r")
    return logps.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_margin"), F.stddev_pop(d).alias("std_margin"))


def split_half_noise(rollouts: DataFrame) -> DataFrame:
    """m, se, delta: half the gap of even and odd prompts' means, and the mean; rollouts(prompt_id, m, x)."""
    even = F.col("prompt_id") % 2 == 0
    return rollouts.groupBy("m").agg((F.abs(F.avg(F.when(even, F.col("x"))) - F.avg(F.when(~even, F.col("x")))) / 2).alias("se"), F.avg("x").alias("delta"))


def signal_to_noise(noise: DataFrame) -> DataFrame:
    return noise.agg(F.percentile("se", 0.5).alias("median_se"), F.avg(F.abs("delta")).alias("mean_abs")).withColumn("snr", F.when(F.col("median_se") > 0, F.col("mean_abs") / F.col("median_se")))
