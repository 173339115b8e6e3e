"""Details, listings and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import strip
from tessera.operators import audit as A, details as D, explore as E, labels as L
from tessera.plans import inputs as I
from tessera.queries.common import BASE, R, registry
from tessera.queries.views import _B1, _b1, _scores, rounded

QUERIES, SQL, query = registry()


@query("e13_binarize", f"{BASE} SELECT side, CAST(freq > 0.05 AS INT) AS fired, count(*) AS n FROM features GROUP BY 1, 2")
def e13(spark, d):
    return D.binarize(I.features(spark, d), 0.05).groupBy("side", "fired").agg(F.count(F.lit(1)).alias("n"))


@query("e17_example_view", "SELECT page_id, trim(coalesce(url, ''), ' \t\n\r') AS url FROM pages")
def e17(spark, d):
    return I.base(spark, d, "pages").select("page_id", strip(F.col("url")).alias("url"))


@query("j11_valid_semi", f"{BASE} SELECT row_idx, m, u_num FROM scores WHERE m IN (SELECT CAST(n_nationkey AS INT) FROM nation WHERE n_regionkey = 1)")
def j11(spark, d):
    valid = I.base(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("m"))
    return _scores(spark, d).join(F.broadcast(valid), "m", "left_semi").select("row_idx", "m", "u_num")


@query("j14_member_subset", f"{BASE} SELECT side, count(*) AS n FROM features WHERE feature IN (SELECT feature FROM clusters WHERE m <= 8) GROUP BY side")
def j14(spark, d):
    return D.member_subset(I.features(spark, d), I.clusters(spark, d).where("m <= 8")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("g27_direction_counts", f"{BASE} SELECT m, count(*) FILTER (u > 0) AS n_amplify, count(*) FILTER (u < 0) AS n_suppress FROM scores GROUP BY m")
def g27(spark, d):
    return D.direction_counts(_scores(spark, d))


@query("w8_top_members", f"{BASE}, o AS (SELECT feature, sum(max_act) AS total FROM features WHERE side <> 'P' GROUP BY 1), r AS (SELECT m, feature, total, row_number() OVER (PARTITION BY m ORDER BY round(total, 6) DESC, feature) AS rank FROM clusters JOIN o USING (feature)) SELECT m, feature, {R('total')} AS total, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def w8(spark, d):
    return rounded(D.top_members(I.features(spark, d), I.clusters(spark, d)), "total")


@query("q14_activation_examples", f"{BASE} SELECT row_idx, {R('act')} AS act FROM (SELECT row_idx, sum(max_act) AS act FROM features JOIN clusters USING (feature) WHERE side <> 'P' AND m = 4 GROUP BY 1) WHERE act > 0 ORDER BY round(act, 6) DESC, row_idx LIMIT 12")
def q14(spark, d):
    return rounded(D.activation_examples(I.features(spark, d), I.clusters(spark, d), 4), "act")


@query("w14_exemplars", f"{BASE}, r AS (SELECT m, row_idx, row_number() OVER (PARTITION BY m ORDER BY round(abs(u), 9) DESC, row_idx) AS rank FROM scores) SELECT m, row_idx, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def w14(spark, d):
    return D.exemplars(_scores(spark, d), "m", F.abs("u"), 5)


@query("q13_cluster_detail", f"{_B1} SELECT 'size' AS section, CAST(2 AS BIGINT) AS a, count(*) AS b, 0.0e0 AS x FROM assignments WHERE k = 2 UNION ALL SELECT * FROM (SELECT 'hypothesis', CAST(k AS BIGINT), CAST(m AS BIGINT), {R('delta')} FROM hy WHERE k = 2 ORDER BY abs(delta) DESC, m LIMIT 10)")
def q13(spark, d):
    return rounded(D.cluster_detail("bk", 2, I.features(spark, d), I.clusters(spark, d), I.assignments(spark, d), _b1(spark, d)), "x")


@query("s12_run_summary", f"{_B1} SELECT k, m, {R('delta_min')} AS delta_min, (SELECT count(*) FROM hy) AS n_all FROM hy ORDER BY round(hy.delta_min, 9) DESC, k, m LIMIT 10")
def s12(spark, d):
    return rounded(D.run_summary(_b1(spark, d), [F.desc(F.round("delta_min", 9)), F.col("k"), F.col("m")]).select("k", "m", "delta_min", "n_all"), "delta_min")


_UB = f"{BASE}, p AS (SELECT feature, CAST(sum(CASE side WHEN 'C' THEN 1 ELSE -1 END) AS DOUBLE) AS net FROM features WHERE side <> 'P' AND freq > 0.01 GROUP BY 1), ub AS (SELECT m, sum(coalesce(net, 0)) / (SELECT count(*) FROM examples) / count(*) AS u_bar FROM clusters LEFT JOIN p USING (feature) GROUP BY m)"


def _u_bar(spark, d):
    return A.global_disparity(I.features(spark, d), I.clusters(spark, d), I.examples(spark, d))


@query("q21_validation_universe", f"{_UB}, r AS (SELECT m, u_bar, row_number() OVER (ORDER BY round(abs(u_bar), 9) DESC, m) AS rank FROM ub WHERE m % 2 = 0) SELECT m, {R('u_bar')} AS u_bar, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def q21(spark, d):
    valid = I.clusters(spark, d).where("m % 2 = 0").select("m").distinct()
    return rounded(D.validation_universe(_u_bar(spark, d), valid, 5), "u_bar")


_FV = "fv AS (SELECT feature, sum(CASE WHEN side = 'C' THEN freq ELSE 0 END) AS x, sum(CASE WHEN side = 'R' THEN freq ELSE 0 END) AS y FROM features WHERE side <> 'P' GROUP BY feature)"


def _fv(spark, d):
    one = lambda s: F.sum(F.when(F.col("side") == s, F.col("freq")).otherwise(0.0))
    return I.features(spark, d).where("side <> 'P'").groupBy("feature").agg(one("C").alias("x"), one("R").alias("y"))


@query("g36_cluster_means", f"{BASE}, {_FV} SELECT m, {R('avg(x)')} AS mean FROM clusters LEFT JOIN fv USING (feature) GROUP BY m")
def g36(spark, d):
    return rounded(D.cluster_means(_fv(spark, d).select("feature", "x"), I.clusters(spark, d)), "mean")


@query("g37_cluster_validation", f"{BASE}, {_FV}, cs AS (SELECT m, count(*) AS n_features, sum(x) AS px, sum(y) AS py, avg(x) AS mx, avg(y) AS my FROM clusters JOIN fv USING (feature) GROUP BY m HAVING count(*) >= 4), rr AS (SELECT corr(px, py) AS r FROM cs) SELECT m, n_features, {R('px')} AS predicted_sum, {R('py')} AS observed_sum, {R('mx')} AS predicted_mean, {R('my')} AS observed_mean, {R('r')} AS pearson_r, {R('r * r')} AS r2 FROM cs, rr")
def g37(spark, d):
    return rounded(D.cluster_validation(_fv(spark, d), I.clusters(spark, d)), "predicted_sum", "observed_sum", "predicted_mean", "observed_mean", "pearson_r", "r2")


@query("g54_distinct_counts", f"{_B1} SELECT count(DISTINCT k) AS n_k, count(DISTINCT m) AS n_m, count(*) AS n FROM hy")
def g54(spark, d):
    return _b1(spark, d).agg(F.countDistinct("k").alias("n_k"), F.countDistinct("m").alias("n_m"), F.count(F.lit(1)).alias("n"))


@query("u1_family_counts", "SELECT family, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'A' WHEN p_size % 4 = 1 THEN 'B' WHEN p_size % 4 = 2 THEN 'R' ELSE 'T' END AS family FROM part) GROUP BY ROLLUP (family)")
def u1f(spark, d):
    s = F.col("p_size") % 4
    return D.family_counts(I.base(spark, d, "part").select(F.when(s == 0, "A").when(s == 1, "B").when(s == 2, "R").otherwise("T").alias("family")))


@query("u3_union_chunks", "SELECT o_orderkey AS row_idx, o_totalprice AS x FROM orders")
def u3(spark, d):
    o = I.base(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("x"))
    return o.where("row_idx % 3 = 0").unionByName(o.where("row_idx % 3 = 1")).unionByName(o.where("row_idx % 3 = 2"))


@query("u4_overlap", f"{BASE}, a AS (SELECT row_idx FROM scores WHERE m = 3 ORDER BY round(s, 9) DESC, row_idx LIMIT 200), b AS (SELECT row_idx FROM scores WHERE m = 3 ORDER BY round(abs(u), 9) DESC, row_idx LIMIT 200) SELECT row_idx FROM a INTERSECT SELECT row_idx FROM b")
def u4(spark, d):
    s = _scores(spark, d).where("m = 3")
    top = lambda c: s.orderBy(F.desc(F.round(c, 9)), "row_idx").limit(200).select("row_idx")
    return top(F.col("s")).intersect(top(F.abs("u")))


@query("u9_fallback", "SELECT CAST(n_nationkey AS INT) AS m, CASE WHEN n_nationkey < 10 AND n_nationkey % 3 <> 0 THEN n_name ELSE 'other' END AS title FROM nation")
def u9(spark, d):
    n = I.base(spark, d, "nation").select(F.col("n_nationkey").alias("m"), F.col("n_name").alias("title"))
    return D.with_fallback(n.where("m < 10").withColumn("title", F.when(F.col("m") % 3 == 0, "").otherwise(F.col("title"))), n.withColumn("title", F.lit("other")), "m", "title")


@query("f5_formats", "SELECT p_partkey, printf('%+.5f', p_retailprice / 1000) AS a, printf('%.2f', p_retailprice) AS b FROM part")
def f5(spark, d):
    return I.base(spark, d, "part").select("p_partkey", F.format_string("%+.5f", F.col("p_retailprice") / 1000).alias("a"), F.format_string("%.2f", F.col("p_retailprice")).alias("b"))


@query("f10_keyword_clean", "SELECT c_custkey, lower(trim(c_mktsegment)) AS first, 2 AS n FROM customer")
def f10(spark, d):
    k = L.clean_keywords(F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("  "), F.col("c_name")))
    return I.base(spark, d, "customer").select("c_custkey", F.get(k, 0).alias("first"), F.size(k).alias("n"))


@query("f21_label_prompt", "SELECT n_nationkey, 'Nation' || chr(10) || '1. ' || left(n_name, 4) || chr(10) || '2. x' AS text FROM nation")
def f21(spark, d):
    return I.base(spark, d, "nation").select("n_nationkey", L.examples_text(F.lit("Nation"), F.array("n_name", F.lit("x")), 4).alias("text"))


@query("o1_ranking", f"{_B1} SELECT k, m, row_number() OVER (ORDER BY round(delta_min, 9) DESC, k, m) AS place FROM hy")
def o1(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy(F.desc(F.round("delta_min", 9)), "k", "m")  # one row a hypothesis
    return _b1(spark, d).select("k", "m", F.row_number().over(w).cast("long").alias("place"))


@query("e19_conditions", "SELECT * FROM (VALUES (7, 'amplify', 0.03e0), (4, 'suppress', 0.01e0), (9, 'amplify', 0.01e0), (5, 'amplify', 0.01e0), (3, 'suppress', 0.01e0)) v(m, direction, threshold)")
def e19(spark, d):
    return spark.createDataFrame(E.parse_conditions("7:amplify:0.03,4:suppress,abc:amplify,9:amplify:notafloat,,5:backflip,6, 3 : suppress : "), "m int, direction string, threshold double")


@query("m5_sub_communities")
def m5(spark, d):
    from tessera.operators import communities as C, graph

    e = graph.edges(graph.mi_pairs(I.features(spark, d), I.examples(spark, d).count()), 20.0)
    return C.sub_communities(e, I.clusters(spark, d), 1.5, 10)
