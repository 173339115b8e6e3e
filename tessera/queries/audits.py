"""Audits, validation, interventions and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import r6
from tessera.operators import audit as A
from tessera.plans import inputs as I
from tessera.queries.common import BASE, R, registry
from tessera.queries.views import RS, _scores, rounded
from tessera.sources import storage

QUERIES, SQL, query = registry()

_DIR = ", dr AS (SELECT row_idx, m, CASE WHEN u > 0.08 THEN 'amp' WHEN u < -0.08 THEN 'sup' ELSE 'neutral' END AS dir FROM scores WHERE s > 0), mo AS (SELECT * FROM (VALUES ('amp_sup', 'amp', 'sup'), ('amp_amp', 'amp', 'amp'), ('sup_sup', 'sup', 'sup'), ('amp_neutral', 'amp', 'neutral')) v(mode, x, y)), dm AS (SELECT m, dir, count(*) AS c FROM dr GROUP BY 1, 2), ms AS (SELECT DISTINCT m FROM dr), jo AS (SELECT a.m AS a, b.m AS b, a.dir AS x, b.dir AS y, count(*) AS c FROM dr a JOIN dr b ON a.row_idx = b.row_idx AND a.m <> b.m GROUP BY 1, 2, 3, 4), de AS (SELECT mode, p.m AS a, q.m AS b, coalesce(da.c, 0) AS demand_a, coalesce(db.c, 0) AS demand_b, coalesce(jo.c, 0) AS joint FROM mo CROSS JOIN ms p JOIN ms q ON p.m <> q.m LEFT JOIN dm da ON da.m = p.m AND da.dir = mo.x LEFT JOIN dm db ON db.m = q.m AND db.dir = mo.y LEFT JOIN jo ON jo.a = p.m AND jo.b = q.m AND jo.x = mo.x AND jo.y = mo.y)"


@query("g31_joint_counts", f"{BASE}{_DIR} SELECT mode, a, b, demand_a, demand_b, joint FROM de")
def g31(spark, d):
    return A.deficits(_scores(spark, d))


@query("g32_scan_summary", f"{BASE}{_DIR} SELECT mode, count(*) AS n_pairs, count(*) FILTER (joint = 0) AS n_zero, count(*) FILTER (joint <= 5) AS n_le5, count(*) FILTER (joint <= 10) AS n_le10 FROM de GROUP BY mode")
def g32(spark, d):
    return A.scan_summary(A.deficits(_scores(spark, d)))


@query("w16_bottlenecks", f"{BASE}{_DIR} SELECT mode, a, b, demand_a, demand_b, joint, {R('joint / CAST(greatest(1, demand_a) AS DOUBLE)')} AS joint_ratio, CASE WHEN joint = 0 THEN 'Critical Zero' WHEN joint <= 3 THEN 'Severe Deficit' ELSE 'Moderate Deficit' END AS severity, 'T_' || a AS title_a, 'T_' || b AS title_b FROM de WHERE demand_a >= 60 AND demand_b >= 50 AND joint <= 5")
def w16(spark, d):
    return rounded(A.bottlenecks(A.deficits(_scores(spark, d)), demand_a=60), "joint_ratio")


@query("g33_coverage", f"{BASE}, x AS (SELECT feature, max(max_act) AS a FROM features WHERE side = 'C' GROUP BY 1) SELECT count(*) AS n_members, count(*) FILTER (coalesce(a, 0) > 0.5) AS n_covered, {R('count(*) FILTER (coalesce(a, 0) > 0.5) / CAST(count(*) AS DOUBLE)')} AS coverage FROM clusters LEFT JOIN x USING (feature) WHERE m = 3")
def g33(spark, d):
    return rounded(A.latent_coverage(I.features(spark, d), I.examples(spark, d), I.clusters(spark, d).where("m = 3"), 0.5), "coverage")


@query("g34_sufficiency", f"""WITH x AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS id, CASE WHEN o_custkey % 40 <> 7 THEN count(*) % 61 END AS n, 16 AS n_features, (o_custkey % 40) * 16 // 39 AS n_active FROM orders GROUP BY o_custkey % 40),
y AS (SELECT *, coalesce(n, 0) AS c, n_active / 16.0e0 AS cov FROM x)
SELECT id, {R('100 * cov')} AS coverage_pct, CAST(16 - n_active AS BIGINT) AS dead_count, CAST(least(c, n_active) AS BIGINT) AS rank_bound, {R('least(100, (1 - pow(1 - c / 260000.0e0, 64)) * 100)')} AS batch_visibility_pct,
{R('CASE WHEN c > 1 THEN 0.2e0 / greatest(1e-6, sqrt(greatest(0.05e0, 0.06e0) / c + 0.06e0 / 1000)) ELSE 0 END')} AS welch_z, {R('100 * (1 - cov) * exp(-c / 50.0e0)')} AS risk_score, CAST(CASE WHEN n IS NULL OR 100 * cov < 95 THEN greatest(150, floor(16 * 8.5)) ELSE 0 END AS INT) AS recommended_quota,
CASE WHEN n IS NULL THEN 'UNINDEXED' WHEN c <= 3 OR 100 * cov < 25 THEN 'CRITICAL' WHEN c < 30 OR 100 * cov < 75 THEN 'DEFICIENT' ELSE 'SUFFICIENT' END AS verdict FROM y""")
def g34(spark, d):
    x = I.base(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("id")).agg((F.count(F.lit(1)) % 61).alias("n"))
    x = x.select("id", F.when(F.col("id") != 7, F.col("n")).alias("n"), F.lit(16).alias("n_features"), F.expr("id * 16 DIV 39").alias("n_active"), *(F.lit(v).alias(c) for c, v in (("mean_in", 0.3), ("mean_out", 0.1), ("var_in", 0.05), ("var_out", 0.06), ("n_out", 1000))))
    return rounded(A.sufficiency(x).select("id", "coverage_pct", "dead_count", "rank_bound", "batch_visibility_pct", "welch_z", "risk_score", "recommended_quota", "verdict"), "coverage_pct", "batch_visibility_pct", "welch_z", "risk_score")


@query("g33_dead_features", f"{BASE} SELECT m, feature FROM clusters WHERE feature NOT IN (SELECT feature FROM features WHERE side = 'C' GROUP BY 1 HAVING max(max_act) > 0.98)")
def g33d(spark, d):
    return A.dead_features(I.features(spark, d), I.examples(spark, d), I.clusters(spark, d), 0.98)


@query("g35_global_disparity", f"{BASE}, p AS (SELECT feature, CAST(sum(CASE side WHEN 'C' THEN 1 ELSE -1 END) AS DOUBLE) AS net FROM features WHERE side <> 'P' AND freq > 0.01 GROUP BY 1) SELECT m, {R('sum(coalesce(net, 0)) / (SELECT count(*) FROM examples) / count(*)')} AS u_bar FROM clusters LEFT JOIN p USING (feature) GROUP BY m")
def g35(spark, d):
    return rounded(A.global_disparity(I.features(spark, d), I.clusters(spark, d), I.examples(spark, d)), "u_bar")


_XY = "xy AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_retailprice + p_size * 3 END AS y FROM part)"


def _xy(spark, d):
    return I.view(spark, d, "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_retailprice + p_size * 3 END AS y FROM part")


@query("g38_regression", f"WITH {_XY} SELECT count(*) AS n, {R('regr_slope(y, x)')} AS slope, {R('regr_intercept(y, x)')} AS intercept, {R('regr_r2(y, x)')} AS r2, {R('corr(x, y)')} AS pearson_r FROM xy WHERE y IS NOT NULL")
def g38(spark, d):
    return rounded(A.validation(_xy(spark, d)), "slope", "intercept", "r2", "pearson_r")


_RK = ", rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS ry FROM xy WHERE y IS NOT NULL)"


@query("g40_spearman", f"WITH {_XY}{_RK} SELECT count(*) AS n, {R('corr(rx, ry)')} AS spearman_r FROM rk")
def g40(spark, d):
    return rounded(A.spearman(_xy(spark, d)), "spearman_r")


@query("g41_top_k", f"WITH {_XY}, r AS (SELECT *, row_number() OVER (ORDER BY abs(y) DESC, id) AS rk FROM xy WHERE y IS NOT NULL), k AS (SELECT unnest([20, 50, 100]) AS k) SELECT CAST(k AS INT) AS k, count(*) AS n, {R('corr(x, y)')} AS pearson_r, {R('corr(x, y) ** 2')} AS r2 FROM r JOIN k ON rk <= k GROUP BY k")
def g41(spark, d):
    return rounded(A.top_k_validation(_xy(spark, d).where("y IS NOT NULL").select("id", F.col("y").alias("x"), F.col("x").alias("y"))), "pearson_r", "r2")


@query("g45_sign_agreement", f"WITH {_XY} SELECT {R('avg(CASE WHEN sign(x - 25) = sign(y - 1500) THEN 1.0e0 ELSE 0 END)')} AS sign_agreement FROM xy")
def g45(spark, d):
    return rounded(A.sign_agreement(_xy(spark, d).select((F.col("x") - 25).alias("x"), (F.col("y") - 1500).alias("y"))), "sign_agreement")


_RO = "ro AS (SELECT o_orderkey AS prompt_id, CAST(o_custkey % 12 AS INT) AS m, o_totalprice / 100000 AS x FROM orders), no AS (SELECT m, abs(avg(x) FILTER (prompt_id % 2 = 0) - avg(x) FILTER (prompt_id % 2 <> 0)) / 2 AS se, avg(x) AS delta FROM ro GROUP BY m)"


def _rollouts(spark, d):
    return I.view(spark, d, "SELECT o_orderkey AS prompt_id, CAST(o_custkey % 12 AS INT) AS m, o_totalprice / 100000 AS x FROM orders")


@query("g46_split_half_noise", f"WITH {_RO} SELECT m, {RS('se', 'delta')} FROM no")
def g46(spark, d):
    return rounded(A.split_half_noise(_rollouts(spark, d)), "se", "delta")


@query("g46_signal_to_noise", f"WITH {_RO} SELECT {R('quantile_cont(se, 0.5)')} AS median_se, {R('avg(abs(delta))')} AS mean_abs, {R('avg(abs(delta)) / quantile_cont(se, 0.5)')} AS snr FROM no")
def g46s(spark, d):
    return rounded(A.signal_to_noise(A.split_half_noise(_rollouts(spark, d))), "median_se", "mean_abs", "snr")


@query("g47_reward_margin", f"SELECT count(*) AS n, {R('avg(l_discount - l_tax)')} AS mean_margin, {R('stddev_pop(l_discount - l_tax)')} AS std_margin FROM lineitem")
def g47(spark, d):
    return rounded(A.reward_margin(I.base(spark, d, "lineitem").select(F.col("l_discount").alias("logp_c"), F.col("l_tax").alias("logp_r"))), "mean_margin", "std_margin")


_CC = "cc AS (SELECT DISTINCT p_partkey AS feature, CAST(p_size AS INT) AS m FROM part), z AS (SELECT m, count(*) AS size FROM cc GROUP BY m)"


def _cc(spark, d):
    return I.view(spark, d, "SELECT DISTINCT p_partkey AS feature, CAST(p_size AS INT) AS m FROM part")


@query("g48_size_audit", f"WITH {_CC}, a AS (SELECT quantile_cont(CAST(size AS DOUBLE), 0.5) AS md FROM z) SELECT count(*) AS n, min(size) AS min_size, max(size) AS max_size, {R('avg(size)')} AS mean_size, {R('any_value(md)')} AS median_size, count(*) FILTER (size > 2 * md) AS n_large FROM z, a")
def g48(spark, d):
    return rounded(A.size_audit(_cc(spark, d)), "mean_size", "median_size")


@query("g48_size_histogram", f"WITH {_CC} SELECT CASE WHEN size < 5 THEN '<5' WHEN size < 10 THEN '5-9' WHEN size < 20 THEN '10-19' WHEN size < 50 THEN '20-49' WHEN size < 100 THEN '50-99' ELSE '100+' END AS bucket, count(*) AS n FROM z GROUP BY 1")
def g48h(spark, d):
    return A.size_histogram(_cc(spark, d))


@query("g49_s_versus_u", f"{BASE}, f AS (SELECT row_idx, t.m, coalesce(s, 0) AS s, coalesce(u, 0) AS u FROM examples CROSS JOIN t LEFT JOIN scores USING (row_idx, m)), c AS (SELECT m, corr(s, u) AS corr, count(*) FILTER (u = 0) AS n_zero_u FROM f GROUP BY m), r AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY round(s, 9) DESC, row_idx) AS a, row_number() OVER (PARTITION BY m ORDER BY round(abs(u), 9) DESC, row_idx) AS b FROM scores) SELECT c.m, {R('corr')} AS corr, n_zero_u, count(*) FILTER (a <= 5 AND b <= 5) AS overlap FROM c JOIN r USING (m) GROUP BY ALL")
def g49(spark, d):
    return rounded(A.s_versus_u(_scores(spark, d), I.examples(spark, d).count()), "corr")


@query("j10_purge", f"{BASE} SELECT row_idx, example_id FROM examples JOIN assignments USING (row_idx) WHERE k NOT IN (1, 5)")
def j10(spark, d):
    return A.purge(I.examples(spark, d), I.assignments(spark, d), [1, 5])


@query("f12_loss_weights", f"{BASE} SELECT row_idx, {R('1 / (1 + exp(-coalesce(u, 0) / 0.5))')} AS weight FROM examples LEFT JOIN (SELECT row_idx, u FROM scores WHERE m = 3) USING (row_idx)")
def f12(spark, d):
    return rounded(A.loss_weights(_scores(spark, d), I.examples(spark, d), 3, 0.5), "weight")


@query("g53_weight_summary", f"{BASE}, w AS (SELECT 1 / (1 + exp(-coalesce(u, 0))) AS w FROM examples LEFT JOIN (SELECT row_idx, u FROM scores WHERE m = 3) USING (row_idx)) SELECT count(*) AS n, {R('avg(w)')} AS mean_w, {R('min(w)')} AS min_w, {R('max(w)')} AS max_w FROM w")
def g53(spark, d):
    w = A.loss_weights(_scores(spark, d), I.examples(spark, d), 3)
    return w.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("weight")).alias("mean_w"), r6(F.min("weight")).alias("min_w"), r6(F.max("weight")).alias("max_w"))


@query("g55_steering", f"WITH x AS (SELECT unnest(embedding) AS w, generate_subscripts(embedding, 1) - 1 AS dim, (vec_id + 1) / 2.0e0 AS scale FROM embeddings WHERE vec_id < 5), v AS (SELECT dim, sum(CAST(w AS DOUBLE) * scale) AS v FROM x GROUP BY dim) SELECT CAST(dim AS INT) AS dim, {R('v / sqrt((SELECT sum(v * v) FROM v))')} AS value FROM v")
def g55(spark, d):
    e = I.base(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.col("embedding").cast("array<double>").alias("weights"))
    scales = spark.range(5).select(F.col("id").alias("feature"), ((F.col("id") + 1) / 2.0).alias("scale"))
    return rounded(A.steering_vector(e, scales), "value")


@query("o8_permutation_split", "SELECT o_orderkey AS row_idx, CASE WHEN row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) <= 1000 THEN 'eval' ELSE 'train' END AS part FROM orders")
def o8(spark, d):
    from tessera.operators.communities import row_sample

    e = I.examples(spark, d).select("row_idx")
    return e.join(row_sample(e, 1000).withColumn("part", F.lit("eval")), "row_idx", "left").fillna("train", ["part"])


@query("g42_permutation_p", f"""WITH {_XY}, v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM xy WHERE y IS NOT NULL), rp AS (SELECT v.id AS i, r.rep, (SELECT count(*) FROM v) AS size FROM v, (SELECT unnest(range(200)) AS rep) r),
pm AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || i), i) - 1 AS j FROM rp), pr AS (SELECT rep, corr(a.x, b.y) AS r FROM pm JOIN v a ON a.id = i JOIN v b ON b.id = j GROUP BY rep),
bm AS (SELECT rep, CAST('0x' || substr(md5('0:1:' || rep || ':' || i), 1, 8) AS BIGINT) % size AS i, CAST('0x' || substr(md5('0:2:' || rep || ':' || i), 1, 8) AS BIGINT) % size AS j FROM rp), br AS (SELECT rep, corr(a.x, b.y) ** 2 AS r2 FROM bm JOIN v a ON a.id = i JOIN v b ON b.id = j GROUP BY rep),
nx AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY md5('1:1:' || rep || ':' || i), i) AS pl FROM rp), ny AS (SELECT rep, i AS j, row_number() OVER (PARTITION BY rep ORDER BY md5('1:2:' || rep || ':' || i), i) AS pl FROM rp),
nr AS (SELECT rep, corr(a.x, b.y) ** 2 AS r2 FROM nx JOIN ny USING (rep, pl) JOIN v a ON a.id = i JOIN v b ON b.id = j WHERE pl <= 50 GROUP BY rep)
SELECT {R("(SELECT (1 + count(*) FILTER (abs(r) >= abs((SELECT corr(x, y) FROM v)) - 1e-12)) / 201.0e0 FROM pr)")} AS p_perm, {R("(SELECT quantile_cont(r2, 0.025) FROM br)")} AS lo, {R("(SELECT quantile_cont(r2, 0.975) FROM br)")} AS hi, {R("(SELECT avg(r2) FROM nr)")} AS mean_r2, {R("(SELECT quantile_cont(r2, 0.95) FROM nr)")} AS p95_r2""")
def g42(spark, d):
    xy = storage.number_rows(_xy(spark, d).where("y IS NOT NULL").withColumnRenamed("id", "part"), ["part"], "id").select("id", "x", "y")
    return rounded(A.permutation_p(xy, 200).crossJoin(A.bootstrap_ci(xy, 200)).crossJoin(A.negative_control(xy, 200)), "p_perm", "lo", "hi", "mean_r2", "p95_r2")


@query("t1_stream_statistics", f"SELECT CAST(user_id % 8 AS INT) AS k, event_type AS m, count(*) AS n, {R('sum(value)')} AS s, {R('sum(value * value)')} AS q FROM events GROUP BY 1, 2")
def t1(spark, d):
    from tessera.streaming.statistics import stream_statistics

    return rounded(stream_statistics(spark, f"{d}/events.parquet*", I.base(spark, d, "events").schema), "s", "q")
