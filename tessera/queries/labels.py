"""Label passes, cluster details and text clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.stats import r6
from tessera.operators import explore as E, label_passes as P, labels as L, prompt_view as V
from tessera.plans import inputs as I
from tessera.queries.common import BASE, R, registry
from tessera.queries.features import _STOPS
from tessera.queries.views import _AK, _B1, _B2, _CS, _RU, _b1, _pk, _scores, rounded

QUERIES, SQL, query = registry()

#: Texts of the examples: the customer's comment words stand for a prompt, the order's fields for the responses.
_SPANS = "SELECT o_orderkey AS row_idx, ' ' || n_name || ' wants ' || c_mktsegment || ' ' AS prompt, o_orderpriority || ' shipping' AS chosen, CASE WHEN o_orderstatus = 'F' THEN c_mktsegment || ' finished' ELSE n_name || ' waiting' END AS rejected FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def _spans(spark, d):
    return I.view(spark, d, _SPANS)


def _labelled(samples: str, title: str = "title") -> str:
    """SQL of the keyword labels of samples(m, place, text)."""
    return f"""lt AS (SELECT m, place, i AS pos, token FROM (SELECT m, place, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT m, place, list_filter(list_transform(regexp_extract_all(lower(text), '[^{L.BLANK}]+'), lambda x: trim(x, '.,!?;:''\"()')), lambda x: length(x) >= 5 AND x NOT IN ({_STOPS})) AS w FROM {samples}))),
lr AS (SELECT m, token, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, min(place * 100000 + pos), token) AS r FROM lt GROUP BY m, token), la AS (SELECT m, list(token ORDER BY r) AS w FROM lr WHERE r <= 5 GROUP BY m),
lb AS (SELECT m, left('Topic Cluster ' || m || ': ' || upper(left(array_to_string(w[1:2], '/'), 1)) || substr(array_to_string(w[1:2], '/'), 2), 120) AS title, left('Cluster containing responses associated with ' || array_to_string(w[1:4], ', ') || '.', 600) AS description, array_to_string(w, ' ') AS keywords FROM (SELECT m, coalesce(w, []) AS w FROM (SELECT DISTINCT m FROM {samples}) LEFT JOIN la USING (m)))"""


def _text(head: str) -> str:
    return f"{head} || chr(10) || 'Prompt: ' || left(trim(prompt, ' \t\n\r'), 140) || chr(10) || 'Chosen (Promoted): ' || left(trim(chosen, ' \t\n\r'), 160) || chr(10) || 'Rejected (Suppressed): ' || left(trim(rejected, ' \t\n\r'), 160) AS text"


_ACT = f"""sp AS ({_SPANS}), av AS (SELECT m, row_idx, round(sum(max_act), 9) AS score FROM features JOIN clusters USING (feature) WHERE side <> 'P' GROUP BY 1, 2 HAVING sum(max_act) > 0), wt AS (SELECT m, least(30, greatest(4, count(*) // 2)) AS want FROM clusters GROUP BY m),
qs AS (SELECT m, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM av GROUP BY m), dd AS (SELECT m, row_idx, score, len(list_filter(q, lambda c: score >= c)) AS decile FROM av JOIN qs USING (m)),
rr AS (SELECT *, row_number() OVER (PARTITION BY m, decile ORDER BY score DESC, row_idx) AS r FROM dd JOIN wt USING (m)), pl AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY decile, r) AS p FROM rr WHERE r <= greatest(1, want // 10)),
sm AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY score DESC, row_idx) AS place, {_text("printf('[Activation: %.3f]', score)")} FROM pl JOIN sp USING (row_idx) WHERE p <= want)"""


@query("q6_feature_labels", f"{BASE}, {_ACT}, {_labelled('sm')} SELECT m, title, description, keywords FROM lb")
def q6(spark, d):
    got = P.feature_labels(I.features(spark, d), I.clusters(spark, d), _spans(spark, d))
    return got.withColumn("keywords", F.array_join("keywords", " "))


_DISP = f"""sp AS ({_SPANS}), wt AS (SELECT m, least(30, greatest(4, count(*) // 2)) AS want FROM clusters GROUP BY m), rk AS (SELECT m, row_idx, u, row_number() OVER (PARTITION BY m ORDER BY abs(u_num) DESC, row_idx) AS place FROM scores WHERE u_num <> 0),
sm AS (SELECT m, place, {_text("printf('[Disparity: u=%+.3f]', u)")} FROM rk JOIN wt USING (m) JOIN sp USING (row_idx) WHERE place <= want)"""


@query("q7_disparity_labels", f"{BASE}, {_DISP}, {_labelled('sm')}, ba AS (SELECT DISTINCT m, 'T' || m AS title FROM clusters WHERE m <= 12) SELECT m, ba.title, lb.title AS disparity_title, lb.description AS disparity_description, lb.keywords AS disparity_keywords FROM ba LEFT JOIN lb USING (m)")
def q7(spark, d):
    base = I.clusters(spark, d).where("m <= 12").select("m", F.concat(F.lit("T"), F.col("m").cast("string")).alias("title")).distinct()
    got = P.disparity_labels(base, _scores(spark, d), I.clusters(spark, d), _spans(spark, d))
    return got.withColumn("disparity_keywords", F.array_join("disparity_keywords", " "))


_RESP = "vv AS (SELECT row_idx, m AS k, abs(u) AS c FROM ru)"
_FAM = f"""tp AS (SELECT k, row_idx, rank, coalesce(c, 0) AS score FROM (SELECT g.k, row_idx, c, row_number() OVER (PARTITION BY g.k ORDER BY round(coalesce(c, 0), 9) DESC, row_idx) AS rank FROM examples CROSS JOIN g LEFT JOIN vv USING (row_idx, k)) WHERE rank <= 5),
sp AS ({_SPANS}), tk AS (SELECT k, score, unnest(list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: trim(x, '''')), lambda x: length(x) >= 5 AND regexp_full_match(x, '\\p{{L}}+') AND x NOT IN ({_STOPS}))) AS token FROM tp JOIN tx USING (row_idx) WHERE score > 0),
tw AS (SELECT k, token, sum(score) AS weight FROM tk GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(weight, 9) DESC, token) AS rank FROM tw)"""


def _family(values: str, text: str) -> str:
    return f"{BASE}, {_AK}, {_CS}, {_RU}, g AS ({'SELECT DISTINCT k FROM pk' if values == 'cs' else 'SELECT DISTINCT m AS k FROM clusters'}), {'vv AS (SELECT * FROM cs)' if values == 'cs' else _RESP}, tx AS (SELECT row_idx, {text} AS text FROM ({_SPANS})), {_FAM}"


_ALL = "SELECT 'example' AS section, k, rank, row_idx, NULL AS token, {} AS x FROM tp UNION ALL SELECT 'token', k, rank, NULL, token, {} FROM tr WHERE rank <= 8".format(R("score"), R("weight"))


def _families(spark, d, prompt: bool):
    f, e, s = I.features(spark, d), I.examples(spark, d), _spans(spark, d)
    e = e.join(s, "row_idx")
    if prompt:
        return P.family_examples(V.c_scores(f, _pk(spark, d)), "k", "c", _pk(spark, d), e, "prompt")
    u = V.ru_scores(f, I.clusters(spark, d)).withColumn("c", F.abs("u"))
    return P.family_examples(u, "m", "c", I.clusters(spark, d), e, "chosen")


def _both(got, key):
    x, t = got
    x = x.select(F.lit("example").alias("section"), F.col(key).alias("k"), F.col("rank").cast("long").alias("rank"), "row_idx", F.lit(None).cast("string").alias("token"), r6(F.col("score")).alias("x"))
    return x.unionByName(t.select(F.lit("token").alias("section"), F.col(key).alias("k"), F.col("rank").cast("long").alias("rank"), F.lit(None).cast("long").alias("row_idx"), "token", r6(F.col("weight")).alias("x")))


@query("q8_prompt_exemplars", f"{_family('cs', 'prompt')} {_ALL}")
def q8a(spark, d):
    return _both(_families(spark, d, True), "k")


@query("q8_response_exemplars", f"{_family('ru', 'chosen')} {_ALL}")
def q8r(spark, d):
    return _both(_families(spark, d, False), "m")


_ONE = "SELECT section, CAST(rank AS INT) AS place, row_idx, token, x FROM ({}) WHERE k = {} AND (section = 'token' OR rank <= 3)"


@query("q13_prompt_detail", f"{_family('cs', 'prompt')} {_ONE.format(_ALL, 2)}")
def q13a(spark, d):
    return rounded(P.family_detail(*_families(spark, d, True), "k", 2, 3), "x")


@query("q17_response_examples", f"{_family('ru', 'chosen')} {_ONE.format(_ALL, 5)}")
def q17(spark, d):
    return rounded(P.family_detail(*_families(spark, d, False), "m", 5, 3), "x")


@query("q14_disparity_examples", f"{BASE} SELECT row_idx, {R('abs(u)')} AS x, CAST(row_number() OVER (ORDER BY round(abs(u), 9) DESC, row_idx) AS INT) AS place FROM scores WHERE m = 4 AND u <> 0 QUALIFY place <= 12")
def q14d(spark, d):
    return rounded(P.ranked_examples(I.features(spark, d), _scores(spark, d), I.clusters(spark, d), 4, 12, "disparity"), "x")


_COND = "3:amplify:0.03,5:suppress,99:amplify"


@query("q12_condition_counts", f"{BASE} SELECT m, direction, (SELECT count(*) FROM scores s WHERE s.m = v.m AND CASE direction WHEN 'amplify' THEN u > 0 ELSE u < 0 END) AS n_total FROM (VALUES (3, 'amplify'), (5, 'suppress'), (99, 'amplify')) v(m, direction)")
def q12c(spark, d):
    return P.condition_counts(_scores(spark, d), E.parse_conditions(_COND))


@query("u7_condition_members", f"{BASE} SELECT DISTINCT feature FROM clusters WHERE m IN (3, 5)")
def u7(spark, d):
    return P.condition_members(I.clusters(spark, d), E.parse_conditions(_COND))


@query("o2_prompt_ranking", f"{_B2} SELECT k, m, row_number() OVER (ORDER BY round(abs(z_score), 6) DESC, k, m) AS place FROM b2")
def o2(spark, d):
    from pyspark.sql import Window

    e = I.examples(spark, d)
    h = V.hypotheses(I.features(spark, d), e, _pk(spark, d), I.clusters(spark, d), e.count())
    w = Window.orderBy(F.desc(F.round(F.abs("z_score"), 6)), "k", "m")  # one row a hypothesis
    return h.select("k", "m", F.row_number().over(w).cast("long").alias("place"))


@query("o7_catalog_order", f"{_B1}, kn AS (SELECT DISTINCT m FROM hy) SELECT CAST(n_nationkey AS INT) AS m, CASE WHEN n_regionkey = 0 THEN 'T_' || n_nationkey ELSE n_name END AS title, kn.m IS NOT NULL AS has_hypotheses FROM nation LEFT JOIN kn ON kn.m = n_nationkey")
def o7(spark, d):
    n = I.base(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("m"), F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("title"))
    return P.catalog_order(n, _b1(spark, d))


@query("f3_words", f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '[^{L.BLANK}]+'), lambda x: trim(x, '.,!?;:''\"()')), lambda x: x <> ''), ' ') AS words FROM documents")
def f3(spark, d):
    return I.base(spark, d, "documents").select("doc_id", F.array_join(L.bare_words(F.col("text")), " ").alias("words"))


@query("f9_clean_title", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS title FROM customer")
def f9(spark, d):
    made = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' "Cluster of user prompts on: '), "c_mktsegment", F.lit('" '))).otherwise("Cluster of  ab")
    return I.base(spark, d, "customer").select("c_custkey", X.clean_title(made, F.lit("none")).alias("title"))


@query("f15_card_set", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'qwen3-1.7b/' || p_size || '-resid-batchtopk-65k__l0-80' WHEN p_size % 3 = 1 THEN 'gemma-2-2b/' || p_size || '-gemmascope-mlp-16k' END AS cards FROM part")
def f15(spark, d):
    s = F.col("p_size") % 3
    got = X.card_set(F.when(s == 1, "google/Gemma-Scope-2b-mlp"), F.lit(None).cast("string"), F.when(s == 0, "models/Qwen3-1.7B"), F.col("p_size"), F.lit(None).cast("int"))
    return I.base(spark, d, "part").select("p_partkey", F.concat_ws("/", got["model"], got["sae"]).alias("c")).select("p_partkey", F.nullif("c", F.lit("")).alias("cards"))
