"""Hand-checked fixtures, invariants and metamorphic properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A, communities as C, explore as E, features as X, graph, labels as L, primitives as P, prompt_view as V
from tessera.operators.welch import consistency, pool_size, welch_grid
from tessera.plans.pipelines import Config, feature_view, run
from tessera.sources import examples as S, storage


def cells(spark, rows):
    return spark.createDataFrame([(int(i), s, int(f), float(a), float(q)) for i, s, f, a, q in rows], "row_idx long, side string, feature int, max_act double, freq double")


@pytest.fixture(scope="module")
def twelve(spark):
    """Rows 0-5: chosen fires feature 0. Rows 6-11: rejected fires 0 and chosen fires 2."""
    rows = [(i, "C", 0, 1, 1) for i in range(6)] + [x for i in range(6, 12) for x in ((i, "R", 0, 1, 1), (i, "C", 2, 1, 1))]
    return cells(spark, rows), spark.createDataFrame([(0, 1), (2, 2)], "feature int, m int"), spark.range(12).select(F.col("id").alias("row_idx"), F.col("id").alias("example_id"))


def test_primitives_by_hand(twelve):
    f, c, e = twelve
    got = {(r["row_idx"], r["m"]): (r["s"], r["u"], r["v"]) for r in P.scores(f, c).collect()}
    want = {(i, 1): (1, 1, 1) for i in range(6)} | {(i, 1): (1, -1, -1) for i in range(6, 12)} | {(i, 2): (1, 1, 1) for i in range(6, 12)}
    assert got == want
    norm = {r["row_idx"]: r["s_norm"] for r in P.norms(P.scores(f, c), e.union(e.sparkSession.createDataFrame([(99, 99)], e.schema))).collect()}
    assert norm[0] == 1 and norm[7] == pytest.approx(2**0.5) and norm[99] == 0


def test_welch_by_hand(spark, twelve):
    f, c, _ = twelve
    a = spark.createDataFrame([(i, 1 if i < 6 else 2) for i in range(12)], "row_idx long, k int")
    g = {(r["k"], r["m"]): r for r in consistency(welch_grid(P.scores(f, c), a, pool_size(a), split=True)).collect()}
    r = g[1, 1]
    assert (r["u_in"], r["u_out"], r["delta"], r["delta_a"], r["delta_b"], r["delta_min"]) == (1, -1, 2, 2, 2, 2) and r["sign_consistent"] and r["is_chosen_leaning"]
    assert r["z_score"] == pytest.approx(2e6) and r["cohens_d"] == pytest.approx(2e6)
    assert g[1, 2]["delta"] == -1 and g[2, 2]["delta"] == 1
    top = feature_view(P.scores(f, c), a, Config(min_feature_cluster=1, min_data_cluster=2)).collect()
    assert [(x["k"], x["m"]) for x in top] == [(1, 1), (2, 1), (1, 2), (2, 2)]


def test_swapping_sides_negates(spark):
    rng = np.random.default_rng(0)
    rows = {(int(rng.integers(0, 60)), str(rng.choice(["C", "R"])), int(rng.integers(0, 12))): float(rng.random()) for _ in range(500)}
    f = cells(spark, [(i, s, x, v, v) for (i, s, x), v in rows.items()])
    swapped = f.withColumn("side", F.when(F.col("side") == "C", "R").otherwise("C"))
    c = spark.createDataFrame([(i, i % 3 + 1) for i in range(12)], "feature int, m int")
    a = spark.createDataFrame([(i, i // 2 % 4 + 1) for i in range(60)], "row_idx long, k int")
    one, two = ({(r["k"], r["m"]): r for r in welch_grid(P.scores(x, c), a, pool_size(a), split=True).collect()} for x in (f, swapped))
    for key, r in one.items():
        for col in ("u_in", "u_out", "delta", "z_score", "cohens_d", "delta_a", "delta_b"):
            assert two[key][col] == pytest.approx(-r[col], abs=1e-9)
    inside = f.join(a, "row_idx")
    for k, m in ((1, 1), (3, 2)):  # the definition, directly
        u = {i: 0.0 for i in range(60)} | {r["row_idx"]: r["u"] for r in P.scores(f, c).where(F.col("m") == m).collect()}
        x, y = [v for i, v in u.items() if i // 2 % 4 + 1 == k], [v for i, v in u.items() if i // 2 % 4 + 1 != k]
        z = (np.mean(x) - np.mean(y)) / math.sqrt(np.var(x, ddof=1) / len(x) + np.var(y, ddof=1) / len(y) + 1e-12)
        assert one[k, m]["z_score"] == pytest.approx(z, rel=1e-9) and inside is not None


def test_percentile_and_silent(spark):
    n = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 5, 9])], "row_idx long, s_norm double")
    rows = P.silent(n, 5).collect()
    assert rows[0]["gamma"] == pytest.approx(1.15) and sum(r["silent"] for r in rows) == 1


def test_union_probability_is_the_direct_one(spark):
    rng = np.random.default_rng(1)
    x = rng.random((2, 50, 20)) < 0.3
    f = cells(spark, [(i, "CR"[s], j, 1, 1) for s, i, j in zip(*np.nonzero(x))])
    got = {r["feature"]: r["union_p1"] for r in X.union_probability(f, 50).collect()}
    assert got == pytest.approx({int(j): v for j, v in enumerate((x[0] | x[1]).mean(axis=0)) if v})
    both = {r["feature"]: r["n_union"] for r in X.inclusion_exclusion(f).collect()}
    assert both == {j: round(v * 50) for j, v in got.items()}
    a, b = (sorted(map(tuple, g(f).collect())) for g in (graph.cooccurrence, lambda f: graph.cooccurrence_blocked(f, 20, 7, 16)))
    assert a == b


def test_conditions():
    assert E.parse_conditions("7:amplify:0.03,4:suppress") == [(7, "amplify", 0.03), (4, "suppress", 0.01)]
    assert E.parse_conditions("abc:amplify,9:amplify:notafloat,,5:backflip,7, 3 : suppress :") == [(9, "amplify", 0.01), (5, "amplify", 0.01), (3, "suppress", 0.01)]
    assert E.parse_conditions("1:suppress", 0.5) == [(1, "suppress", 0.5)] and E.parse_conditions("") == []


def test_live_queries(spark):
    vec = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "feature int, act double")
    c = spark.createDataFrame([(0, 10), (1, 10), (2, 20), (99, 30)], "feature int, m int")
    assert {r["m"]: r["signal"] for r in E.cluster_signals(vec, c, 4).collect()} == {10: 3, 20: 3, 30: 0}
    assert {r["m"]: r["signal"] for r in E.cluster_signals(vec, c, 4, "mean").collect()}[10] == 1.5
    assert E.cluster_signals(vec.limit(0), c, 4).count() == 0
    h = spark.createDataFrame([(1, 1, 0.5), (1, 2, -0.4), (2, None, 9.0)], "k int, m int, delta double")
    s = spark.createDataFrame([(1, 2.0)], "m int, signal double")
    assert [r["evidence"] for r in E.evidence(h, s).orderBy("k", "m").collect()] == [1.0, 0.0, 0.0]
    u = spark.createDataFrame([(i, 5, float(v)) for i, v in enumerate([2, 1, 0, -1, -3, 0.5])], "row_idx long, m int, u double")
    top, total = E.rank_samples(u, 5)
    assert [r["u"] for r in top.collect()] == [2, 1, 0.5] and total.first()[0] == 3
    top, total = E.rank_samples(u, 5, "suppress")
    assert [r["u"] for r in top.collect()] == [-3, -1] and total.first()[0] == 2
    two = spark.createDataFrame([(i, m, float(v)) for m, vs in ((1, [1, 2, -1, 3, 0]), (2, [4, -1, -2, 1, 0])) for i, v in enumerate(vs)], "row_idx long, m int, u double")
    got = E.rank_compound(two, [(1, "amplify", 0), (2, "amplify", 0)], {1, 2}).collect()
    assert [(r["row_idx"], r["score"]) for r in got] == [(0, 5), (3, 4)]
    assert E.rank_compound(two, [(9, "amplify", 0)], {1, 2}).count() == 5
    assert E.rank_compound(two, [(9, "amplify", 0)], {1, 2}, rows=spark.range(9).withColumnRenamed("id", "row_idx")).count() == 9
    with pytest.raises(ValueError):
        E.rank_compound(two, [], {1, 2}, strict=True)
    ex = spark.range(5).select(F.col("id").alias("row_idx"))
    scores = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 3, -1, 2])], "row_idx long, score double")
    assert {r["row_idx"] for r in E.top_examples(scores, ex).collect()} == {1, 3}
    assert E.family(" Bk ") == "B" and E.family("response") == "R"


def test_leiden_splits_two_cliques():
    e = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(6) for b in range(a + 1, 6)] + [(0, 10, 0.05)]
    src, dst, w = map(np.array, zip(*e))
    got = C.leiden(src, dst, w)
    assert {got[i] for i in range(6)} == {0} and {got[i] for i in range(10, 16)} == {1}
    assert C.modularity(src, dst, w, got) > C.modularity(src, dst, w, {v: v for v in got})
    rng = np.random.default_rng(2)
    src, dst = rng.integers(0, 80, 600), rng.integers(80, 160, 600)
    got = C.leiden(src, dst, np.ones(600), 1.0)
    assert set(got) == {*src, *dst} and C.modularity(src, dst, np.ones(600), got) > C.modularity(src, dst, np.ones(600), {v: v for v in got})


def test_label_propagation(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 9, 0.1), (9, 8, 1.0), (8, 7, 1.0), (7, 6, 1.0)], "src int, dst int, weight double")
    assert dict(map(tuple, C.label_propagation(e, 0.5).collect())) == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6}


def test_kmeans_labels_are_nearest_and_svd_reconstructs(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 5)) + np.eye(5)[np.arange(60) % 5] * 4
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "row_idx long, x array<double>")
    got = {r["row_idx"]: r["k"] for r in C.kmeans(v, "row_idx", 5, 1).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = np.stack([unit[[i for i in got if got[i] == k]].mean(axis=0) for k in sorted(set(got.values()))])
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    assert all(sorted(set(got.values()))[int((unit[i] @ mean.T).argmax())] == k for i, k in got.items())
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(5)], "row_idx long, feature int, x double")
    emb = C.svd_embedding(long, 4, 60).to_numpy()
    s = np.linalg.svd(x.T, compute_uv=False)
    assert np.linalg.norm(emb, axis=0) == pytest.approx(s[:4])


def test_p_values():
    assert A.p_value(0.0, 10) == pytest.approx(1.0) and A.p_value(1.0, 10) == 0 and A.p_value(0.5, 2) == 1
    assert A.p_value(-0.0762, 12) == pytest.approx(0.814, abs=2e-3)
    assert A.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_examples_and_lookup(spark):
    turns = "array<struct<role:string,content:string>>"
    rows = [(0, [("user", " hi "), ("assistant", "good")], [("user", "hi"), ("assistant", "bad ")]), (1, [("user", "x"), ("assistant", "  ")], [("user", "x"), ("assistant", "y")]), (2, None, None)]
    got = S.extract(spark.createDataFrame(rows, f"example_id long, chosen {turns}, rejected {turns}")).collect()
    assert [tuple(r) for r in got] == [(0, "hi", "good", "bad")]
    flat = spark.createDataFrame([(i, f"prompt {i} — ünïcode ✓", f"c{i}", f"r{i}") for i in range(50)], "example_id long, prompt string, chosen string, rejected string")
    assert S.extract(flat, max_samples=7).count() == 7 and S.extract(flat.withColumn("example_id", F.col("example_id") * 10 + 10), max_samples=7).agg(F.max("example_id")).first()[0] == 70 and S.extract(flat.drop("rejected")).count() == 0
    num = storage.number_rows(flat, [F.desc("example_id")])
    assert {r["example_id"]: r["row_idx"] for r in num.collect()} == {i: 49 - i for i in range(50)}
    assert [r["row_idx"] for r in S.lookup(num, -1, n=50).collect()] == [49] and S.lookup(num, 10, 20).count() == 10
    a, b = storage.fingerprint(flat, d=3).first(), storage.fingerprint(flat.where("example_id <> 4"), d=3).first()
    assert a["ex_hash"] != b["ex_hash"] and a["n"] == 50 and len(a["ex_hash"]) == 16
    assert storage.fingerprint(flat.orderBy(F.rand(1)), d=3).first() == a


def test_labels(spark):
    texts = ['{"title": "A", "description": "d", "keywords": [" X ", "", "y"]}', 'Sure:\n```json\n{"title": "B"}\n```', 'broken {"title": "C", "description": ', None, "nothing"]
    got = [r["l"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.parse_label(F.col("t")).alias("l")).collect()]
    assert [g["title"] for g in got] == ["A", "B", "C", None, None] and got[0]["keywords"] == ["x", "y"]
    old, new = (spark.createDataFrame(r, "k int, title string") for r in ([(0, "kept")], [(0, "other"), (1, "new")]))
    assert sorted(map(tuple, L.merge_labels(old, new).collect())) == [(0, "kept"), (1, "new")]


def test_top_expressers_fill_with_zeros(spark):
    c = spark.createDataFrame([(5, 1, 0.5), (3, 1, 0.9), (2, 2, 0.1)], "row_idx long, k int, c double")
    e = spark.range(8).select(F.col("id").alias("row_idx"))
    got = {k: [r["row_idx"] for r in V.top_expressers(c, e, 4).where(F.col("k") == k).orderBy("rank").collect()] for k in (1, 2)}
    assert got == {1: [3, 5, 0, 1], 2: [2, 0, 1, 3]} and V.top_expressers(c, e, 4, require_active=True).count() == 3


def test_validation_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    assert A.validation(df([(0, 1.0, None)])).first()["n"] == 0
    r = A.validation(df([(0, 1.0, 2.0), (1, 2.0, 4.0), (2, float("nan"), 1.0)])).first()
    assert (r["n"], r["slope"], r["intercept"]) == (2, 2, 0) and r["r2"] == pytest.approx(1)
    assert A.validation(df([(0, 1.0, 2.0), (1, 1.0, 4.0)])).first()["pearson_r"] == 0
    xy = df([(i, float(i), float(i * i % 17)) for i in range(17)])
    p = A.permutation_p(xy, 50).first()[0]
    assert 0 < p <= 1 and A.permutation_p(xy.repartition(3), 50).first()[0] == p
    ci = A.bootstrap_ci(xy, 50, paired=True).first()
    assert 0 <= ci["lo"] <= ci["hi"] <= 1
    wide = A.negative_control(xy, 300, k=5).first()
    assert 0 < wide["mean_r2"] < wide["p95_r2"] <= 1


def test_label_rules(spark):
    from tessera.operators import details as D, labels as L

    df = spark.createDataFrame([(1, 0, "Naïve users' \"ABOUT\" été2 l'école x_words «quoted» it's-hyphen (apples), apples!")], "k int, place int, text string")
    assert [r["token"] for r in L.tokens(df).orderBy("pos").collect()] == ["naïve", "users", "quoted", "hyphen", "apples", "apples"]
    assert [r["token"] for r in L.keyword_tokens(df).orderBy("pos").collect()] == ["naïve", "users", "l'école", "x_words", "«quoted»", "it's-hyphen", "apples", "apples"]
    samples = df.unionByName(spark.createDataFrame([(0, 0, "silent words"), (3, 0, ""), (4, 0, "other words")], df.schema))
    got = {r["k"]: r for r in L.label_clusters(samples, spark.createDataFrame([(4, "kept", "d", ["w"])], "k int, title string, description string, keywords array<string>")).collect()}
    assert got[1]["title"] == "Topic Cluster 1: Apples/naïve" and got[1]["keywords"][0] == "apples" and got[0]["title"] == "Silent Bucket (B_0)" and got[3]["keywords"] == [] and got[4]["title"] == "kept"
    own = L.label_clusters(samples, spark.createDataFrame([], "k int, title string, description string, keywords array<string>"), lambda s: s.where("k = 1").selectExpr("k", "'mine' title", "'' description", "array('a') keywords"))
    assert {r["k"]: r["title"] for r in own.collect()} == {1: "mine", 0: "Silent Bucket (B_0)", 3: "Topic Cluster 3: ", 4: "Topic Cluster 4: Words"}
    lists = spark.createDataFrame([(1, []), (2, ["x"])], "m int, v array<string>")
    full = D.with_fallback(lists, spark.createDataFrame([(1, ["a"]), (3, ["c"])], lists.schema), "m", "v")
    assert {r["m"]: r["v"] for r in full.collect()} == {1: ["a"], 2: ["x"], 3: ["c"]}


def test_bottlenecks_and_sufficiency(spark):
    d = spark.createDataFrame([("amp_sup", 1, 2, 300, 60, 4), ("amp_sup", 1, 3, 300, 60, 0), ("amp_sup", 2, 3, 900, 60, 0), ("amp_sup", 2, 1, 900, 49, 0), ("amp_sup", 3, 1, 199, 60, 0), ("amp_sup", 4, 1, 300, 60, 6), ("amp_sup", 5, 1, 300, 60, 3)], "mode string, a int, b int, demand_a long, demand_b long, joint long")
    got = A.bottlenecks(d, labels=spark.createDataFrame([(3, "three")], "m int, title string")).collect()
    assert [(r["a"], r["b"], r["severity"]) for r in got] == [(2, 3, "Critical Zero"), (1, 3, "Critical Zero"), (5, 1, "Severe Deficit"), (1, 2, "Moderate Deficit")]
    assert got[0]["title_a"] == "T_2" and got[0]["title_b"] == "three" and got[3]["joint_ratio"] == 4 / 300
    x = spark.createDataFrame([(1, None, 40, None), (2, 3, 40, 40), (3, 29, 40, 40), (4, 500, 40, 29), (5, 500, 40, 38), (6, 1, 10, 2)], "id int, n long, n_features int, n_active int").selectExpr("*", "0.3D mean_in", "0.1D mean_out", "0.0D var_in", "0.0D var_out", "100 n_out")
    r = {v["id"]: v for v in A.sufficiency(x).collect()}
    assert [r[i]["verdict"] for i in range(1, 7)] == ["UNINDEXED", "CRITICAL", "DEFICIENT", "DEFICIENT", "SUFFICIENT", "CRITICAL"]
    assert [r[i]["recommended_quota"] for i in range(1, 7)] == [340, 0, 0, 340, 0, 150] and r[1]["risk_score"] == 100 and r[6]["welch_z"] == 0 and r[3]["welch_z"] == pytest.approx(0.2 / 1e-6)


def test_long_chains_settle(spark):
    from tessera.operators.communities import label_propagation

    e = spark.range(300).selectExpr("cast(id as int) src", "cast(id + 1 as int) dst", "1.0D weight")
    assert {r["root"] for r in label_propagation(e).collect()} == {0}


def test_whole_run(spark):
    rng = np.random.default_rng(4)
    rows = {}
    for i in range(400):
        g = i % 4
        for s in "PCR":
            for f in rng.choice(np.arange(g * 8, g * 8 + 8), 4, replace=False):
                rows[i, s, int(f)] = float(rng.random()) * (2 if s == "C" else 1)
    out = run(spark, cells(spark, [(*k, v, v) for k, v in rows.items()]), spark.range(400).select(F.col("id").alias("row_idx")), Config(n_data_clusters=4, min_feature_cluster=2, top_percent=40.0, n_prompt_clusters=3, n_response_clusters=3))
    s = out["summary"].first()
    assert s["num_examples"] == 400 and s["num_feature_clusters"] == 4 and out["assignments"].count() == 400
    with pytest.raises(ValueError):
        Config(silent_percent=120)


def test_exact_percentile(spark):
    df = spark.createDataFrame([(float(i * 7 % 101) if i else None,) for i in range(102)], "x double")
    for share in (0.0, 0.05, 0.333, 0.5, 1.0):
        want = np.percentile([float(i * 7 % 101) for i in range(1, 102)], 100 * share)
        assert storage.exact_percentile(df, "x", share, "p").first()["p"] == pytest.approx(want)
    assert storage.exact_percentile(df.limit(0), "x", 0.5, "p").first()["p"] is None


def test_stream_goes_on(spark, tmp_path):
    from tessera.streaming.statistics import stream_statistics

    path, more = f"file://{tmp_path}/events", dict(out=f"file://{tmp_path}/out", checkpoint=f"file://{tmp_path}/ck")
    for n in (1, 2):
        spark.createDataFrame([(8, "a", 1.5), (1, "b", 2.0)], "user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)
        got = stream_statistics(spark, path, spark.read.parquet(path).schema, **more)
        assert {(r["k"], r["m"]): (r["n"], r["s"]) for r in got.collect()} == {(0, "a"): (n, 1.5 * n), (1, "b"): (n, 2.0 * n)}
