"""The feature- and prompt-conditioned views and the interactive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import r6
from tessera.operators import explore as E, labels as L, primitives as P, prompt_view as V
from tessera.operators.welch import consistency, pool_size, welch_grid
from tessera.plans import inputs as I, pipelines
from tessera.queries.common import BASE, R, registry

QUERIES, SQL, query = registry()


def _scores(spark, d, weighted=False):
    return P.scores(I.features(spark, d), I.clusters(spark, d), weighted=weighted)


def rounded(df, *columns, digits=6):
    return df.select(*(r6(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def RS(*columns, digits=6):
    return ", ".join(f"{R(c, digits)} AS {c}" for c in columns)


@query("g1_scores", f"{BASE} SELECT row_idx, m, {RS('s', 'u', 'v')}, u_num FROM scores")
def g1(spark, d):
    return rounded(_scores(spark, d).select("row_idx", "m", "s", "u", "v", "u_num"), "s", "u", "v")


@query("g4_u_weighted", f"{BASE} SELECT row_idx, m, {R('v / t_m')} AS u FROM scores")
def g4(spark, d):
    return rounded(_scores(spark, d, True).select("row_idx", "m", "u"), "u")


_SILENT = ", nm AS (SELECT row_idx, coalesce(sqrt(q), 0) AS s_norm FROM examples LEFT JOIN (SELECT row_idx, sum(s * s) AS q FROM scores GROUP BY 1) USING (row_idx))"


@query("g5_norm", f"{BASE}{_SILENT} SELECT row_idx, {R('s_norm')} AS s_norm FROM nm")
def g5(spark, d):
    return rounded(P.norms(_scores(spark, d), I.examples(spark, d)), "s_norm")


@query("g6_silent", f"{BASE}{_SILENT}, o AS (SELECT row_idx, round(s_norm, 9) AS s_norm FROM nm) SELECT row_idx, s_norm < (SELECT quantile_cont(s_norm, 0.05) FROM o) AS silent FROM o")
def g6(spark, d):
    n = P.norms(_scores(spark, d), I.examples(spark, d)).withColumn("s_norm", F.round("s_norm", 9))
    return P.silent(n).select("row_idx", "silent")


_GRID = """,
mem AS (SELECT row_idx, k FROM assignments),
tot AS (SELECT m, sum(u_num) AS ts, sum(u_num * u_num) AS tq, sum(CASE WHEN row_idx % 2 = 0 THEN u_num ELSE 0 END) AS te FROM scores GROUP BY m),
ins AS (SELECT k, m, sum(u_num) AS s, sum(u_num * u_num) AS q, sum(CASE WHEN row_idx % 2 = 0 THEN u_num ELSE 0 END) AS e FROM scores JOIN mem USING (row_idx) GROUP BY 1, 2),
sz AS (SELECT k, count(*) AS n_in, count(*) FILTER (row_idx % 2 = 0) AS e_in FROM mem GROUP BY k),
al AS (SELECT count(*) AS n_pool, count(*) FILTER (row_idx % 2 = 0) AS n_even FROM mem),
gr AS (SELECT sz.k, tot.m, CAST(t_m AS DOUBLE) AS tm, n_in, n_pool - n_in AS n_out, e_in, n_in - e_in AS o_in, n_even - e_in AS e_out, n_pool - n_even - (n_in - e_in) AS o_out,
        coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(e, 0) AS e, ts, tq, te
       FROM sz CROSS JOIN al CROSS JOIN tot JOIN t USING (m) LEFT JOIN ins ON ins.k = sz.k AND ins.m = tot.m),
st AS (SELECT *, s / tm / n_in AS u_in, (ts - s) / tm / n_out AS u_out,
        greatest(0, (q - s * s / CAST(n_in AS DOUBLE)) / (n_in - 1)) / tm / tm AS v_in, greatest(0, (tq - q - (ts - s) * (ts - s) / CAST(n_out AS DOUBLE)) / (n_out - 1)) / tm / tm AS v_out,
        e / tm / e_in - (te - e) / tm / e_out AS delta_a, (s - e) / tm / o_in - (ts - te - s + e) / tm / o_out AS delta_b FROM gr),
w AS (SELECT *, u_in - u_out AS delta, (u_in - u_out) / sqrt(v_in / n_in + v_out / n_out + 1e-12) AS z_score,
        (u_in - u_out) / sqrt(((n_in - 1) * v_in + (n_out - 1) * v_out) / greatest(1, n_in + n_out - 2) + 1e-12) AS cohens_d,
        CASE WHEN e_in > 0 AND e_out > 0 THEN delta_a ELSE 0 END AS da, CASE WHEN o_in > 0 AND o_out > 0 THEN delta_b ELSE 0 END AS db FROM st)"""


@query("g8_welch_grid", f"{BASE}{_GRID} SELECT k, m, n_in, n_out, {RS('u_in', 'u_out', 'delta', 'z_score', 'cohens_d')} FROM w")
def g8(spark, d):
    a = I.assignments(spark, d)
    return rounded(welch_grid(_scores(spark, d).select("row_idx", "m", "u"), a, pool_size(a)), "u_in", "u_out", "delta", "z_score", "cohens_d")


@query("g11_split_half", f"{BASE}{_GRID} SELECT k, m, {R('da')} AS delta_a, {R('db')} AS delta_b, {R('least(abs(da), abs(db))')} AS delta_min FROM w")
def g11(spark, d):
    a = I.assignments(spark, d)
    g = consistency(welch_grid(_scores(spark, d).select("row_idx", "m", "u"), a, pool_size(a), split=True))
    return rounded(g.select("k", "m", "delta_a", "delta_b", "delta_min"), "delta_a", "delta_b", "delta_min")


_B1 = f"{BASE}{_GRID}, hy AS (SELECT *, least(abs(da), abs(db)) AS delta_min FROM w WHERE tm >= 10 AND n_in >= 25 AND abs(da) > 1e-12 AND abs(db) > 1e-12 AND sign(da) = sign(db))"
_HCOLS = ("u_in", "u_out", "delta", "z_score", "cohens_d", "delta_a", "delta_b", "delta_min")


def _b1(spark, d):
    return pipelines.feature_view(_scores(spark, d), I.assignments(spark, d))


@query("b1_hypotheses", f"{_B1} SELECT k, m, n_in AS n_k, CAST(tm AS BIGINT) AS t_m, {RS('u_in', 'u_out', 'delta', 'z_score', 'cohens_d')}, {R('da')} AS delta_a, {R('db')} AS delta_b, true AS sign_consistent, {R('delta_min')} AS delta_min, delta > 0 AS is_chosen_leaning FROM hy")
def b1(spark, d):
    return rounded(_b1(spark, d), *_HCOLS)


_AK = "pk AS (SELECT DISTINCT CAST(o_custkey % 64 AS INT) AS feature, CAST(o_custkey % 64 % 4 + 1 AS INT) AS k FROM orders), pn AS (SELECT k, count(*) AS c FROM pk GROUP BY k)"
_CS = "cs AS (SELECT row_idx, k, sum(freq) / any_value(pn.c) AS c FROM features JOIN pk USING (feature) JOIN pn USING (k) WHERE side = 'P' GROUP BY 1, 2)"
_RU = "ru AS (SELECT row_idx, m, sum(CASE side WHEN 'C' THEN freq ELSE -freq END) / any_value(t_m) AS u FROM features JOIN clusters USING (feature) JOIN t USING (m) WHERE side <> 'P' GROUP BY 1, 2)"


def _pk(spark, d):
    return I.view(spark, d, "SELECT DISTINCT CAST(o_custkey % 64 AS INT) AS feature, CAST(o_custkey % 64 % 4 + 1 AS INT) AS k FROM orders")


@query("g19_c_scores", f"{BASE}, {_AK}, {_CS} SELECT row_idx, k, {R('c')} AS c FROM cs")
def g19(spark, d):
    return rounded(V.c_scores(I.features(spark, d), _pk(spark, d)), "c")


@query("g20_ru_scores", f"{BASE}, {_RU} SELECT row_idx, m, {R('u')} AS u FROM ru")
def g20(spark, d):
    return rounded(V.ru_scores(I.features(spark, d), I.clusters(spark, d)), "u")


_TOP = ", tp AS (SELECT k, row_idx, rank FROM (SELECT k, row_idx, row_number() OVER (PARTITION BY k ORDER BY round(coalesce(cs.c, 0), 9) DESC, row_idx) AS rank FROM examples CROSS JOIN pn LEFT JOIN cs USING (row_idx, k)) WHERE rank <= 200)"


@query("w1_top_expressers", f"{BASE}, {_AK}, {_CS}{_TOP} SELECT k, row_idx, CAST(rank AS INT) AS rank FROM tp")
def w1(spark, d):
    return V.top_expressers(V.c_scores(I.features(spark, d), _pk(spark, d)), I.examples(spark, d)).select("k", "row_idx", F.col("rank").cast("int").alias("rank"))


_B2 = f"""{BASE}, {_AK}, {_CS}, {_RU}{_TOP},
tot AS (SELECT m, sum(u) AS ts, sum(u * u) AS tq FROM ru GROUP BY m), ins AS (SELECT k, m, sum(u) AS s, sum(u * u) AS q FROM ru JOIN tp USING (row_idx) GROUP BY 1, 2),
sz AS (SELECT k, count(*) AS n_in FROM tp GROUP BY k),
gr AS (SELECT sz.k, tot.m, n_in, n.n - n_in AS n_out, coalesce(s, 0) AS s, coalesce(q, 0) AS q, ts, tq FROM sz CROSS JOIN n CROSS JOIN tot LEFT JOIN ins ON ins.k = sz.k AND ins.m = tot.m),
st AS (SELECT *, s / n_in AS u_in, (ts - s) / n_out AS u_out, greatest(0, (q - s * s / n_in) / (n_in - 1)) AS v_in, greatest(0, (tq - q - (ts - s) * (ts - s) / n_out) / (n_out - 1)) AS v_out FROM gr),
b2 AS (SELECT *, u_in - u_out AS delta, (u_in - u_out) / sqrt(v_in / n_in + v_out / n_out + 1e-12) AS z_score, (u_in - u_out) / sqrt(((n_in - 1) * v_in + (n_out - 1) * v_out) / (n_in + n_out - 2) + 1e-12) AS cohens_d FROM st)"""


@query("b2_hypotheses", f"{_B2} SELECT b2.k, b2.m, CAST(pn.c AS INT) AS n_prompt_feats, CAST(t_m AS INT) AS n_resp_feats, {RS('u_in', 'u_out', 'delta', 'z_score', 'cohens_d', digits=9)} FROM b2 JOIN pn USING (k) JOIN t USING (m)")
def b2(spark, d):
    e = I.examples(spark, d)
    return rounded(V.hypotheses(I.features(spark, d), e, _pk(spark, d), I.clusters(spark, d), e.count()), "u_in", "u_out", "delta", "z_score", "cohens_d", digits=9)


_VEC = f"vec AS (SELECT feature, max(max_act) AS act FROM features WHERE side = 'C' AND row_idx IN ({I.LIVE}) GROUP BY feature)"


def _vec(spark, d):
    return I.live(spark, d, I.features(spark, d)).where("side = 'C'").groupBy("feature").agg(F.max("max_act").alias("act"))


_SIG = f"{_VEC}, sg AS (SELECT m, sum(coalesce(act, 0)) AS signal, avg(coalesce(act, 0)) AS mean_signal FROM clusters LEFT JOIN vec USING (feature) GROUP BY m)"


@query("g25_signals", f"{BASE}, {_SIG} SELECT m, {RS('signal', 'mean_signal')} FROM sg")
def g25(spark, d):
    v, c = _vec(spark, d), I.clusters(spark, d)
    both = E.cluster_signals(v, c, 256).join(E.cluster_signals(v, c, 256, "mean").withColumnRenamed("signal", "mean_signal"), "m")
    return rounded(both, "signal", "mean_signal")


_HY = f"{_B1}, {_SIG}, ev AS (SELECT hy.*, abs(delta) * abs(coalesce(signal, 0)) AS evidence FROM hy LEFT JOIN sg USING (m))"


def _signals(spark, d):
    return E.cluster_signals(_vec(spark, d), I.clusters(spark, d), 256)


@query("g26_data_clusters", f"{_HY}, rr AS (SELECT k, m, evidence, row_number() OVER (PARTITION BY k ORDER BY evidence DESC, m) AS r FROM ev) SELECT k, {R('evidence')} AS relevance, m AS best_m FROM rr WHERE r = 1 AND evidence > 0")
def g26(spark, d):
    return rounded(E.score_data_clusters(E.evidence(_b1(spark, d), _signals(spark, d))), "relevance")


@query("g26_best_by_m", f"{_B1}, rr AS (SELECT k, m, delta, row_number() OVER (PARTITION BY m ORDER BY abs(delta) DESC, k) AS r FROM hy) SELECT k, m, {R('delta')} AS delta FROM rr WHERE r = 1")
def g26m(spark, d):
    return rounded(E.best_by_measure(_b1(spark, d)).select("k", "m", "delta"), "delta")


def _labels(spark, d):
    return I.view(spark, d, "SELECT CAST(n_nationkey + 1 AS INT) AS m, n_name AS title FROM nation WHERE n_nationkey < 10")


_LB = "lb AS (SELECT CAST(n_nationkey + 1 AS INT) AS m, n_name AS title FROM nation WHERE n_nationkey < 10)"


@query("q9_mode_a", f"{_HY}, {_LB}, rr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY evidence DESC, m) AS r FROM ev WHERE evidence > 0) SELECT k, m, {R('evidence')} AS evidence, coalesce(title, 'T_' || m) AS title, CASE WHEN delta > 0 THEN 'amplified' ELSE 'suppressed' END AS direction FROM rr LEFT JOIN lb USING (m) WHERE r <= 2 ORDER BY rr.evidence DESC, k, m LIMIT 10")
def q9(spark, d):
    return rounded(E.predicted_shifts(_b1(spark, d), _signals(spark, d), _labels(spark, d)).select("k", "m", "evidence", "title", "direction"), "evidence")


_PAIR = f"""{_B1}, {_LB}, vc AS (SELECT feature, max(max_act) AS c FROM features WHERE side = 'C' AND row_idx IN ({I.LIVE}) GROUP BY 1), vr AS (SELECT feature, max(max_act) AS r FROM features WHERE side = 'R' AND row_idx IN ({I.LIVE}) GROUP BY 1),
uv AS (SELECT feature, CAST(coalesce(c, 0) > 0.01 AS INT) - CAST(coalesce(r, 0) > 0.01 AS INT) AS act FROM vc FULL JOIN vr USING (feature)), sg AS (SELECT m, sum(coalesce(act, 0)) AS signal FROM clusters LEFT JOIN uv USING (feature) GROUP BY m),
bm AS (SELECT k, m FROM (SELECT k, m, row_number() OVER (PARTITION BY m ORDER BY abs(delta) DESC, k) AS r FROM hy) WHERE r = 1),
sd AS (SELECT CASE WHEN signal > 0 THEN 'promoted' ELSE 'suppressed' END AS side, m, k, signal FROM sg JOIN bm USING (m) WHERE signal <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(signal) DESC, m) AS r FROM sd)"""


@query("q10_mode_b", f"{_PAIR} SELECT side, m, k, CAST(signal AS DOUBLE) AS signal, coalesce(title, 'T_' || m) AS title, CASE WHEN abs(signal) > 0.15 THEN 'Strong' WHEN abs(signal) > 0.05 THEN 'Moderate' ELSE 'Weak' END AS strength, CAST(r AS INT) AS rank FROM rk LEFT JOIN lb USING (m) WHERE r <= 5")
def q10(spark, d):
    f = I.features(spark, d)
    one = lambda s: I.live(spark, d, f).where(f"side = '{s}'").groupBy("feature").agg(F.max("max_act").alias("act"))
    sig = E.cluster_signals(E.live_pair(one("C"), one("R")), I.clusters(spark, d), 256)
    return E.pair_concepts(sig, E.best_by_measure(_b1(spark, d)), I.clusters(spark, d), _labels(spark, d)).select("side", "m", "k", "signal", "title", "strength", "rank")


@query("q11_samples", f"{BASE} SELECT row_idx, {R('u')} AS u, (SELECT count(*) FROM scores WHERE m = 3 AND u > 0) AS total_matching FROM scores WHERE m = 3 AND u > 0 ORDER BY scores.u DESC, row_idx LIMIT 12")
def q11(spark, d):
    top, total = E.rank_samples(_scores(spark, d), 3)
    return rounded(top.select("row_idx", "u").crossJoin(F.broadcast(total)), "u")


@query("q12_compound", f"{BASE} SELECT row_idx, {R('sum(abs(u))')} AS score FROM scores WHERE (m = 3 AND u > 0) OR (m = 5 AND u < 0) GROUP BY row_idx HAVING count(*) = 2 ORDER BY sum(abs(scores.u)) DESC, row_idx LIMIT 12")
def q12(spark, d):
    return rounded(E.rank_compound(_scores(spark, d), E.parse_conditions("3:amplify:0.03,5:suppress,abc:amplify,99:amplify"), set(range(1, 17))), "score")


@query("j9_member_firing", f"{BASE}, c AS (SELECT row_idx, feature, max(CASE WHEN side = 'C' THEN freq ELSE 0 END) AS c_freq, max(CASE WHEN side = 'R' THEN freq ELSE 0 END) AS r_freq FROM features JOIN clusters USING (feature) WHERE side <> 'P' AND m = 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY round(c_freq + r_freq, 9) DESC, feature) AS rank FROM c) SELECT row_idx, feature, {RS('c_freq', 'r_freq')}, CASE WHEN c_freq > 0 AND r_freq > 0 THEN 'both' WHEN c_freq > 0 THEN 'chosen' ELSE 'rejected' END AS active_in, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def j9(spark, d):
    return rounded(E.member_firing(I.features(spark, d), I.examples(spark, d), I.clusters(spark, d).where("m = 3")), "c_freq", "r_freq")


@query("w4_top_examples", f"{BASE} SELECT row_idx, example_id, score FROM (SELECT row_idx, CAST(u_num AS DOUBLE) AS score FROM scores WHERE m = 2 ORDER BY u_num DESC, row_idx LIMIT 5) JOIN examples USING (row_idx) WHERE score > 0")
def w4(spark, d):
    s = _scores(spark, d).where("m = 2").select("row_idx", F.col("u_num").cast("double").alias("score"))
    return E.top_examples(s, I.examples(spark, d)).select("row_idx", "example_id", "score")


@query("w7_top_features", f"{BASE}, {_VEC} SELECT v.feature, {R('v.act')} AS act, CASE WHEN t_m >= 4 THEN m END AS parent FROM (SELECT * FROM vec WHERE act > 0 ORDER BY act DESC, feature LIMIT 8) v LEFT JOIN clusters USING (feature) LEFT JOIN t USING (m)")
def w7(spark, d):
    return rounded(E.top_features(_vec(spark, d), I.clusters(spark, d)), "act")


@query("w9_keywords", f"{BASE}, {_VEC}, r AS (SELECT m, feature, act, row_number() OVER (PARTITION BY m ORDER BY act DESC, feature) AS k FROM clusters JOIN vec USING (feature) WHERE act > 0) SELECT m, string_agg(printf('SAE-Feat_%d (act=%.2f)', feature, act), ', ' ORDER BY k) AS keywords FROM r WHERE k <= 3 GROUP BY m")
def w9(spark, d):
    return E.cluster_keywords(_vec(spark, d), I.clusters(spark, d)).select("m", F.array_join("keywords", ", ").alias("keywords"))


@query("w2_covered", f"{_B1}, rk AS (SELECT k, m, row_number() OVER (ORDER BY round(delta_min, 9) DESC, k, m) AS rank FROM hy) SELECT k, m, CAST(place AS INT) AS place FROM (SELECT k, m, row_number() OVER (PARTITION BY m ORDER BY rank) AS place FROM rk) WHERE place <= 2")
def w2(spark, d):
    h = _b1(spark, d).withColumn("rank", F.struct((-F.round("delta_min", 9)).alias("a"), "k", F.col("m").alias("mm")))
    return E.covered(h, 2).select("k", "m", F.col("place").cast("int").alias("place"))


@query("q15_feature_detail", f"{BASE}, c AS (SELECT row_idx, sum(max_act) AS a FROM features WHERE side <> 'P' AND feature = 7 GROUP BY 1) SELECT 7 AS feature, count(*) AS n_examples, {R('max(a)')} AS max_act, {R('avg(a)')} AS mean_act, {R('sum(a)')} AS total, 8 AS parent FROM c WHERE a > 0")
def q15(spark, d):
    return rounded(E.feature_detail(I.features(spark, d), 7, I.clusters(spark, d)), "max_act", "mean_act", "total")


@query("u1_catalog", "WITH a AS (SELECT n_name AS key, 1 AS src FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT n_name, 3 FROM nation WHERE n_nationkey < 5) SELECT key, CAST(min(src) AS INT) AS src FROM a GROUP BY key")
def u1(spark, d):
    n, r = I.base(spark, d, "nation"), I.base(spark, d, "region")
    return E.catalog(n.select(F.col("n_name").alias("key"), F.lit(1).alias("src")), r.select(F.col("r_name").alias("key"), F.lit(2).alias("src")), n.where("n_nationkey < 5").select(F.col("n_name").alias("key"), F.lit(3).alias("src")))


@query("u5_merge_labels", "SELECT n_nationkey AS k, n_name AS title FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 10")
def u5(spark, d):
    n = I.base(spark, d, "nation")
    return L.merge_labels(n.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("title")), n.select(F.col("n_nationkey").alias("k"), F.lit("new").alias("title")))


@query("w10_centroid_nearest", f"""{BASE}{_SILENT}, un AS (SELECT k, row_idx, m, s / s_norm AS x FROM scores JOIN nm USING (row_idx) JOIN assignments USING (row_idx) WHERE s_norm > 0),
sz AS (SELECT k, count(DISTINCT row_idx) AS c FROM un GROUP BY k), ce AS (SELECT k, m, sum(x) / any_value(sz.c) AS c FROM un JOIN sz USING (k) GROUP BY 1, 2), ln AS (SELECT k, sqrt(sum(c * c)) AS l FROM ce GROUP BY k),
co AS (SELECT k, row_idx, sum(x * c) / any_value(l) AS cosine FROM un JOIN ce USING (k, m) JOIN ln USING (k) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(cosine, 9) DESC, row_idx) AS rank FROM co)
SELECT k, row_idx, {R('cosine')} AS cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30""")
def w10(spark, d):
    v = _scores(spark, d).select("row_idx", "m", F.col("s").alias("x"))
    return rounded(L.centroid_nearest(v, I.assignments(spark, d)), "cosine")


@query("w11_random_members", f"{BASE}, r AS (SELECT k, row_idx, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || row_idx), row_idx) AS rank FROM assignments) SELECT k, row_idx, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def w11(spark, d):
    return L.random_members(I.assignments(spark, d))


_WANT = ", wt AS (SELECT m, least(30, greatest(4, count(*) // 2)) AS want FROM clusters GROUP BY m)"
_DEC = _WANT + ", ds AS (SELECT m, row_idx, round(s, 6) AS score FROM scores WHERE round(s, 6) > 0), qs AS (SELECT m, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM ds GROUP BY m), dd AS (SELECT m, row_idx, score, len(list_filter(q, lambda c: score >= round(c, 9))) AS decile FROM ds JOIN qs USING (m)), rr AS (SELECT *, row_number() OVER (PARTITION BY m, decile ORDER BY score DESC, row_idx) AS r FROM dd JOIN wt USING (m))"


@query("w12_deciles", f"{BASE}{_DEC} SELECT m, row_idx, CAST(decile AS INT) AS decile, {R('score')} AS score, CAST(row_number() OVER (PARTITION BY m ORDER BY score DESC, row_idx) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY decile, r) AS place FROM rr WHERE r <= greatest(1, want // 10)) WHERE place <= want")
def w12(spark, d):
    s = _scores(spark, d).select("m", "row_idx", F.round("s", 6).alias("score"))
    return rounded(L.decile_sample(s, I.clusters(spark, d)), "score")


@query("w13_top_disparity", f"{BASE}, wt AS (SELECT m, least(8, greatest(4, count(*) // 2)) AS want FROM clusters GROUP BY m), z AS (SELECT m, row_idx, u_num, row_number() OVER (PARTITION BY m ORDER BY abs(u_num) DESC, row_idx) AS rank FROM scores WHERE u_num <> 0) SELECT m, row_idx, u_num, CAST(rank AS INT) AS rank FROM z JOIN wt USING (m) WHERE rank <= want")
def w13(spark, d):
    s = _scores(spark, d).select("m", "row_idx", F.col("u_num").alias("u"))
    return L.top_disparity(s, I.clusters(spark, d)).select("m", "row_idx", F.col("u").alias("u_num"), F.col("rank").cast("int").alias("rank"))


@query("m1_assign_step", f"{BASE}{_SILENT}, ce AS (SELECT k, m, avg(s) AS c FROM scores JOIN assignments USING (row_idx) GROUP BY 1, 2), cn AS (SELECT k, sqrt(sum(c * c)) AS l FROM ce GROUP BY k), co AS (SELECT row_idx, k, round(sum(s * c) / any_value(l) / any_value(s_norm), 9) AS cosine FROM scores JOIN ce USING (m) JOIN cn USING (k) JOIN nm USING (row_idx) WHERE s_norm > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY cosine DESC, k) AS i FROM co) SELECT row_idx, {R('cosine')} AS cosine FROM r WHERE i = 1")
def m1(spark, d):
    s = _scores(spark, d)
    c = s.join(I.assignments(spark, d), "row_idx").groupBy("k", "m").agg(F.avg("s").alias("x"))
    return rounded(P.nearest_centroid(s.select("row_idx", "m", F.col("s").alias("x")), c).select("row_idx", "cosine"), "cosine")


@query("q1_run_summary")
def q1(spark, d):
    return pipelines.run(spark, I.features(spark, d), I.examples(spark, d), pipelines.Config(top_percent=5.0))["summary"]
