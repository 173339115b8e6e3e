"""Sources, encoding, feature operators and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.stats import r6
from tessera.operators import encode, features as X, graph, labels as L
from tessera.plans import inputs as I
from tessera.queries.common import BASE, R, registry
from tessera.sources import examples as S, storage

QUERIES, SQL, query = registry()
_TURNS = "t AS (SELECT conv_id, list(text ORDER BY turn) AS x, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)"


@query("s1_load_examples", f"WITH d AS ({I.DOC_PAIRS}) SELECT example_id, trim(prompt, ' \t\n\r') AS prompt, trim(chosen, ' \t\n\r') AS chosen, trim(rejected, ' \t\n\r') AS rejected FROM d WHERE trim(prompt, ' \t\n\r') <> '' AND trim(chosen, ' \t\n\r') <> '' AND trim(rejected, ' \t\n\r') <> ''")
def s1(spark, d):
    return S.extract(I.view(spark, d, I.DOC_PAIRS))


@query("s4_first_n", "SELECT o_orderkey * 10 AS example_id, o_orderstatus AS prompt, o_orderpriority AS chosen, o_orderstatus AS rejected FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_orderstatus <> '' AND o_orderpriority <> ''")
def s4(spark, d):
    o = I.base(spark, d, "orders").select((F.col("o_orderkey") * 10).alias("example_id"), F.col("o_orderstatus").alias("prompt"), F.col("o_orderpriority").alias("chosen"), F.col("o_orderstatus").alias("rejected"))
    return S.extract(o, max_samples=100)


def _json(spark, orders):
    path = storage.scratch(spark, "json")
    orders.select(F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("title")).write.json(path)
    return spark.read.schema("example_id long, title string").json(path)


@query("s5_json_round_trip", "SELECT o_orderkey AS example_id, o_orderpriority AS title FROM orders")
def s5(spark, d):
    return _json(spark, I.base(spark, d, "orders"))


@query("s6_point_lookup", "SELECT o_orderkey AS row_idx FROM orders WHERE o_orderkey IN (7, (SELECT count(*) FROM orders) - 3) OR o_orderkey BETWEEN 20 AND 29")
def s6(spark, d):
    o = I.examples(spark, d).select("row_idx")
    n = o.count()
    return S.lookup(o, 7).union(S.lookup(o, -3, n=n)).union(S.lookup(o, 20, 30))


@query("s7_feature_table_round_trip", f"{BASE} SELECT side, count(*) AS n, {R('sum(freq)')} AS total FROM features GROUP BY side")
def s7(spark, d):
    f = I.features(spark, d)
    path = storage.scratch(spark, "features")
    f.sortWithinPartitions("side", "feature").write.partitionBy("side").parquet(path)
    return spark.read.parquet(path).groupBy("side").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("freq")).alias("total"))


@query("s9_resume", "SELECT o_orderkey AS row_idx FROM orders WHERE o_orderkey % 3 <> 0")
def s9(spark, d):
    o = I.examples(spark, d).select("row_idx")
    return storage.pending(o, o.where("row_idx % 3 = 0"))


@query("s10_fingerprint", "WITH b AS (SELECT o_orderkey // 4096 AS b, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS h, count(*) AS c FROM orders GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n, 256 AS d, left(sha256(string_agg(h, '' ORDER BY b)), 16) AS ex_hash FROM b")
def s10(spark, d):
    return storage.fingerprint(I.examples(spark, d), d=256)


@query("s16_feature_urls", "SELECT DISTINCT CAST(l_partkey % 256 AS INT) AS feature, concat('https://cards.example/', 'model', '/', '12-res', '/', l_partkey % 256) AS url FROM lineitem")
def s16(spark, d):
    return I.clusters(spark, d).select("feature", F.concat(F.lit("https://cards.example/model/12-res/"), F.col("feature").cast("string")).alias("url"))


@query("w18_row_numbers", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx FROM events")
def w18(spark, d):
    return storage.number_rows(I.base(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_idx")


@query("e1_turns", f"WITH {_TURNS} SELECT conv_id AS example_id, trim(x[1], ' \t\n\r') AS prompt, trim(x[-1], ' \t\n\r') AS chosen, trim(x[-1], ' \t\n\r') AS rejected FROM t WHERE trim(x[1], ' \t\n\r') <> '' AND trim(x[-1], ' \t\n\r') <> ''")
def e1(spark, d):
    t = I.conv_turns(spark, d).select(F.col("conv_id").alias("example_id"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    return S.extract(t)


@query("e3_template", "SELECT item_id, '<start_of_turn>user' || chr(10) || text || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS gemma, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chatml FROM benchmark")
def e3(spark, d):
    t = F.col("text")
    return I.base(spark, d, "benchmark").select("item_id", F.concat(F.lit("<start_of_turn>user\n"), t, F.lit("<end_of_turn>\n<start_of_turn>model\n")).alias("gemma"), F.concat(F.lit("<|im_start|>user\n"), t, F.lit("<|im_end|>\n<|im_start|>assistant\n")).alias("chatml"))


@query("e4_truncate", "WITH x AS (SELECT doc_id AS row_idx, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents) SELECT row_idx, CAST(least(len(t), 20) AS INT) AS n_prompt, CAST(least(len(t), 50 - least(len(t), 20)) AS INT) AS n_response FROM x")
def e4(spark, d):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    x = I.base(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), t.alias("prompt"), t.alias("response"))
    return X.truncate_spans(x, 20, 50).select("row_idx", F.size("prompt").alias("n_prompt"), F.size("response").alias("n_response"))


_HASHED = """x AS (SELECT doc_id AS row_idx, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents),
a AS (SELECT row_idx, len(t) AS n_tokens, unnest(t) AS token FROM x),
f AS (SELECT row_idx, CAST(CAST('0x' || left(md5(token), 7) AS INT) % 512 AS INT) AS feature, max(1 + length(token) / 10.0e0) AS max_act, count(*) / CAST(any_value(n_tokens) AS DOUBLE) AS freq FROM a GROUP BY 1, 2)"""


def _hashed(spark, d):
    docs = I.base(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("chosen"))
    return X.pool(*encode.hash_encode(docs, 512, None, (("C", "chosen"),)))


@query("e6_span_pool", f"WITH {_HASHED} SELECT row_idx, feature, {R('max_act')} AS max_act, {R('freq')} AS freq FROM f")
def e6(spark, d):
    return _hashed(spark, d).select("row_idx", "feature", r6(F.col("max_act")).alias("max_act"), r6(F.col("freq")).alias("freq"))


@query("e14_delta", f"{BASE} SELECT row_idx, feature, {R('''sum(CASE side WHEN 'C' THEN max_act ELSE -max_act END)''')} AS d_max, {R('''sum(CASE side WHEN 'C' THEN freq ELSE -freq END)''')} AS d_freq FROM features WHERE side <> 'P' GROUP BY 1, 2")
def e14(spark, d):
    return X.delta(I.features(spark, d)).select("row_idx", "feature", r6(F.col("d_max")).alias("d_max"), r6(F.col("d_freq")).alias("d_freq"))


@query("e15_union", f"{BASE} SELECT DISTINCT row_idx, feature FROM features WHERE side <> 'P' AND freq > 0")
def e15(spark, d):
    return X.union_cells(I.features(spark, d))


@query("e18_truncate_text", "SELECT doc_id, left(text, 40) AS head, right(text, 60) AS tail FROM documents")
def e18(spark, d):
    return I.base(spark, d, "documents").select("doc_id", F.left("text", F.lit(40)).alias("head"), F.right("text", F.lit(60)).alias("tail"))


@query("j2_product", f"{BASE} SELECT c.row_idx, c.feature, {R('c.freq * r.freq')} AS cr FROM features c JOIN features r USING (row_idx, feature) WHERE c.side = 'C' AND r.side = 'R'")
def j2(spark, d):
    return X.product(I.features(spark, d)).select("row_idx", "feature", r6(F.col("cr")).alias("cr"))


@query("j3_cooccurrence", f"{BASE} SELECT a.feature AS src, b.feature AS dst, count(*) AS n11 FROM features a JOIN features b ON a.row_idx = b.row_idx AND a.side = b.side AND a.feature < b.feature WHERE a.side <> 'P' GROUP BY 1, 2")
def j3(spark, d):
    return graph.cooccurrence(I.features(spark, d))


@query("j3_cooccurrence_blocked", f"{BASE} SELECT a.feature AS src, b.feature AS dst, count(*) AS n11 FROM features a JOIN features b ON a.row_idx = b.row_idx AND a.side = b.side AND a.feature < b.feature WHERE a.side <> 'P' GROUP BY 1, 2")
def j3_blocked(spark, d):
    return graph.cooccurrence_blocked(I.features(spark, d), 256)


_MI = """,
p AS (SELECT feature, count(*) / (2.0e0 * any_value(n.n)) AS p1 FROM features, n WHERE side <> 'P' AND freq > 0 GROUP BY feature),
c AS (SELECT a.feature AS src, b.feature AS dst, count(*) AS n11 FROM features a JOIN features b ON a.row_idx = b.row_idx AND a.side = b.side AND a.feature < b.feature WHERE a.side <> 'P' GROUP BY 1, 2),
g AS (SELECT a.feature AS src, b.feature AS dst, coalesce(n11, 0) AS n11, coalesce(n11, 0) / (2.0e0 * n.n) AS p11, a.p1 AS pi, b.p1 AS pj FROM p a JOIN p b ON a.feature < b.feature CROSS JOIN n LEFT JOIN c ON c.src = a.feature AND c.dst = b.feature WHERE a.p1 > 0.001 AND b.p1 > 0.001),
q AS (SELECT *, pi - p11 AS p10, pj - p11 AS p01, 1 - p11 - (pi - p11) - (pj - p11) AS p00 FROM g),
h AS (SELECT *, least(1, greatest(1e-7, p11)) AS a, least(1, greatest(1e-7, p10)) AS b, least(1, greatest(1e-7, p01)) AS c, least(1, greatest(1e-7, p00)) AS e,
      -(pi * ln(pi + 1e-12) + (1 - pi) * ln(1 - pi + 1e-12)) AS hi, -(pj * ln(pj + 1e-12) + (1 - pj) * ln(1 - pj + 1e-12)) AS hj FROM q),
mi AS (SELECT src, dst, n11, (a * ln(a / (pi * pj + 1e-7)) + b * ln(b / (pi * (1 - pj) + 1e-7)) + c * ln(c / ((1 - pi) * pj + 1e-7)) + e * ln(e / ((1 - pi) * (1 - pj) + 1e-7))) / (sqrt(hi * hj) + 1e-7) AS weight FROM h)"""


@query("g23_normalized_mi", f"{BASE}{_MI} SELECT src, dst, n11, {R('weight')} AS weight FROM mi")
def g23(spark, d):
    f = I.features(spark, d)
    return graph.mi_pairs(f, I.examples(spark, d).count()).select("src", "dst", "n11", r6(F.col("weight")).alias("weight"))


@query("g24_edges", f"{BASE}{_MI} SELECT src, dst, {R('weight')} AS weight FROM mi WHERE weight > 0 AND weight >= (SELECT quantile_cont(weight, 0.99) FROM mi WHERE weight > 0)")
def g24(spark, d):
    return graph.edges(graph.mi_pairs(I.features(spark, d), I.examples(spark, d).count())).select("src", "dst", r6(F.col("weight")).alias("weight"))


@query("j5_internal_density", f"{BASE}{_MI}, ed AS (SELECT src, dst FROM mi WHERE weight > 0 AND weight >= (SELECT quantile_cont(weight, 0.95) FROM mi WHERE weight > 0)), i AS (SELECT a.m, count(*) AS c FROM ed JOIN clusters a ON a.feature = src JOIN clusters b ON b.feature = dst AND a.m = b.m GROUP BY 1) SELECT t.m, t_m AS size, coalesce(c, 0) AS n_edges, {R('200.0e0 * coalesce(c, 0) / (t_m * (t_m - 1))')} AS density FROM t LEFT JOIN i USING (m) WHERE t_m >= 10")
def j5(spark, d):
    e = graph.edges(graph.mi_pairs(I.features(spark, d), I.examples(spark, d).count()), 5.0)
    return graph.internal_edges(e, I.clusters(spark, d), 10).select("m", "size", "n_edges", r6(F.col("density")).alias("density"))


@query("g14_firing_probability", f"{BASE} SELECT feature, count(*) AS n_fired, {R('count(*) / (2.0e0 * any_value(n.n))')} AS p1 FROM features, n WHERE side <> 'P' AND freq > 0 GROUP BY feature")
def g14(spark, d):
    return X.firing_probability(I.features(spark, d), I.examples(spark, d).count()).select("feature", "n_fired", r6(F.col("p1")).alias("p1"))


@query("g15_union_probability", f"{BASE} SELECT feature, count(DISTINCT row_idx) AS n_rows, {R('count(DISTINCT row_idx) / CAST(any_value(n.n) AS DOUBLE)')} AS union_p1 FROM features, n WHERE side <> 'P' AND freq > 0 GROUP BY feature")
def g15(spark, d):
    return X.union_probability(I.features(spark, d), I.examples(spark, d).count()).select("feature", "n_rows", r6(F.col("union_p1")).alias("union_p1"))


@query("g16_inclusion_exclusion", f"{BASE}, c AS (SELECT row_idx, feature, max(CAST(side = 'C' AS BIGINT)) AS c, max(CAST(side = 'R' AS BIGINT)) AS r FROM features WHERE side <> 'P' AND freq > 0 GROUP BY 1, 2) SELECT feature, CAST(sum(c) AS BIGINT) AS n_c, CAST(sum(r) AS BIGINT) AS n_r, CAST(sum(c * r) AS BIGINT) AS n_both, count(*) AS n_union FROM c GROUP BY feature")
def g16(spark, d):
    return X.inclusion_exclusion(I.features(spark, d))


_MOMENTS = """, d AS (SELECT row_idx, feature, sum(CASE side WHEN 'C' THEN freq ELSE -freq END) AS d FROM features WHERE side <> 'P' GROUP BY 1, 2),
mo AS (SELECT feature, sum(d) / any_value(n.n) AS mean_d, sqrt(greatest(0, sum(d * d) / any_value(n.n) - (sum(d) / any_value(n.n)) ** 2)) AS sigma_d FROM d, n GROUP BY feature)"""


@query("g17_moments", f"{BASE}{_MOMENTS} SELECT feature, {R('mean_d')} AS mean_d, {R('sigma_d')} AS sigma_d FROM mo")
def g17(spark, d):
    return X.delta_moments(I.features(spark, d), I.examples(spark, d).count()).select("feature", r6(F.col("mean_d")).alias("mean_d"), r6(F.col("sigma_d")).alias("sigma_d"))


@query("g18_retention", f"{BASE}{_MOMENTS}, p AS (SELECT feature, count(*) AS p_count FROM features WHERE side = 'P' AND freq > 0 GROUP BY 1), r AS (SELECT feature, count(DISTINCT row_idx) AS r_count FROM features WHERE side <> 'P' AND freq > 0 GROUP BY 1) SELECT feature, coalesce(p_count, 0) AS p_count, coalesce(r_count, 0) AS r_count, coalesce(p_count, 0) >= 200 AS keep_prompt, coalesce(r_count, 0) >= 200 AND coalesce(sigma_d, 0) >= 1e-3 AND abs(coalesce(mean_d, 0)) >= 1e-4 AS keep_response FROM p FULL JOIN r USING (feature) LEFT JOIN mo USING (feature)")
def g18(spark, d):
    return X.retained(I.features(spark, d), I.examples(spark, d).count()).select("feature", "p_count", "r_count", "keep_prompt", "keep_response")


@query("g22_entropy", f"{BASE}{_MI} SELECT feature, {R('-(p1 * ln(p1 + 1e-12) + (1 - p1) * ln(1 - p1 + 1e-12))')} AS h FROM p WHERE p1 > 0 AND p1 < 1")
def g22(spark, d):
    return graph.entropies(I.features(spark, d), I.examples(spark, d).count()).where("p1 > 0 AND p1 < 1").select("feature", r6(F.col("h")).alias("h"))


@query("g29_firing_stats", f"{BASE}, c AS (SELECT row_idx, feature, sum(max_act) AS a FROM features WHERE side <> 'P' GROUP BY 1, 2) SELECT feature, count(*) AS n_examples, {R('max(a)')} AS max_act, {R('avg(a)')} AS mean_act, {R('sum(a)')} AS total FROM c WHERE a > 0 GROUP BY feature")
def g29(spark, d):
    return X.firing_stats(I.features(spark, d)).select("feature", "n_examples", *(r6(F.col(c)).alias(c) for c in ("max_act", "mean_act", "total")))


_STOPS = ", ".join(f"'{w}'" for w in L.STOP)
_TOKENS = f"tk AS (SELECT doc_id, lang, i AS pos, token FROM (SELECT doc_id, lang, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda x: trim(x, '''')), lambda x: length(x) >= 5 AND regexp_full_match(x, '\\p{{L}}+') AND x NOT IN ({_STOPS})) AS w FROM documents)))"


@query("g51_weighted_tokens", f"WITH {_TOKENS}, s AS (SELECT lang, token, CAST(sum(doc_id % 7) AS BIGINT) AS weight FROM tk GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, token) AS rank FROM s) SELECT lang, token, weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def g51(spark, d):
    t = L.tokens(I.base(spark, d, "documents").select("doc_id", "lang", "text")).drop("text").withColumn("w", F.col("doc_id") % 7)
    return L.weighted_tokens(t, "lang", "w")


_WORDS = f"tk AS (SELECT doc_id, lang, i AS pos, token FROM (SELECT doc_id, lang, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(lower(text), '[^{L.BLANK}]+'), lambda x: trim(x, '.,!?;:''\"()')), lambda x: length(x) >= 5 AND x NOT IN ({_STOPS})) AS w FROM documents)))"


@query("g52_keywords", f'WITH {_WORDS}, s AS (SELECT lang, token, count(*) AS count, min(doc_id * 100000 + pos) AS first FROM tk GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, first, token) AS rank FROM s) SELECT lang, token, count, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5')
def g52(spark, d):
    return L.keywords(L.keyword_tokens(I.base(spark, d, "documents").select("doc_id", "lang", "text")).drop("text"), "lang", "doc_id")


_SAMPLES = "sm AS (SELECT CAST(doc_id % 6 AS INT) AS k, row_number() OVER (PARTITION BY doc_id % 6 ORDER BY md5('0:' || doc_id), doc_id) AS place, text FROM documents QUALIFY place <= 20)"
_KEYS = f"lt AS (SELECT k, place, i AS pos, token FROM (SELECT k, place, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT k, place, list_filter(list_transform(regexp_extract_all(lower(text), '[^{L.BLANK}]+'), lambda x: trim(x, '.,!?;:''\"()')), lambda x: length(x) >= 5 AND x NOT IN ({_STOPS})) AS w FROM sm))), lc AS (SELECT k, token, count(*) AS c, min(place * 100000 + pos) AS f FROM lt GROUP BY 1, 2), lr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, f, token) AS r FROM lc), la AS (SELECT k, list(token ORDER BY r) AS w FROM lr WHERE r <= 5 GROUP BY k)"


@query("q5_cluster_labels", f"""WITH {_SAMPLES}, {_KEYS}, lp AS (SELECT k, coalesce(w, []) AS w, array_to_string(coalesce(w, [])[1:2], '/') AS p FROM (SELECT DISTINCT k FROM sm) LEFT JOIN la USING (k))
SELECT k, CASE WHEN k = 2 THEN 'kept' WHEN k = 0 THEN 'Silent Bucket (B_0)' ELSE 'Topic Cluster ' || k || ': ' || upper(left(p, 1)) || substr(p, 2) END AS title, CASE WHEN k = 2 THEN 'done before' WHEN k = 0 THEN 'Examples with low response-side SAE feature activity.' ELSE 'Cluster containing responses associated with ' || array_to_string(w[1:4], ', ') || '.' END AS description, CASE WHEN k = 2 THEN 'own' WHEN k = 0 THEN 'silent low_activation' ELSE array_to_string(w, ' ') END AS keywords FROM lp""")
def q5(spark, d):
    docs = I.base(spark, d, "documents").select((F.col("doc_id") % 6).cast("int").alias("k"), F.col("doc_id").alias("row_idx"), "text")
    samples = L.random_members(docs, 20).select("k", F.col("rank").alias("place"), "text")
    done = spark.createDataFrame([(2, "kept", "done before", ["own"])], "k int, title string, description string, keywords array<string>")
    return L.label_clusters(samples, done).withColumn("keywords", F.array_join("keywords", " "))


@query("f8_json_labels", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS title FROM events")
def f8(spark, d):
    text = F.concat(F.lit("Sure!\n```json\n{\"title\": \""), F.get_json_object("props", "$.k"), F.lit("\", \"keywords\": [\" A \", \"\"]}\n```\nDone"))
    return I.base(spark, d, "events").select("event_id", L.parse_label(text)["title"].alias("title"))


@query("f18_search", "SELECT p_partkey AS key, p_name AS title FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1')")
def f18(spark, d):
    from tessera.operators.explore import search

    p = I.base(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.array(F.lit("none")).alias("keywords"))
    return search(p, "1").select(F.col("id").alias("key"), "title")


@query("m2_gram", f"{BASE} SELECT a.feature AS i, b.feature AS j, {R('sum(a.freq * b.freq)')} AS g FROM features a JOIN features b ON a.row_idx = b.row_idx AND a.feature <= b.feature WHERE a.side = 'P' AND b.side = 'P' GROUP BY 1, 2")
def m2(spark, d):
    from tessera.operators.communities import gram

    return gram(I.features(spark, d).where("side = 'P'").select("row_idx", "feature", F.col("freq").alias("x"))).select("i", "j", r6(F.col("g")).alias("g"))


@query("m6_row_sample", "SELECT o_orderkey AS row_idx FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 300")
def m6(spark, d):
    from tessera.operators.communities import row_sample

    return row_sample(I.examples(spark, d).select("row_idx"), 300)


@query("m4_communities")
def m4(spark, d):
    from tessera.operators.communities import communities

    return communities(graph.edges(graph.mi_pairs(I.features(spark, d), I.examples(spark, d).count()), 5.0), 1.0, 4)


@query("e8_topk_encode")
def e8(spark, d):
    import numpy as np

    rng = np.random.default_rng(0)
    v = I.base(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("x"))
    return encode.topk_encode(v, rng.normal(size=(64, 128)), np.zeros(128), np.zeros(64), 8)
