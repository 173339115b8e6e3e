"""Label passes, clean-up of generated text, and grids over clusters without a cell."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import label_passes as P, labels as L, prompt_view as V
from tessera.operators.welch import pool_size, welch_grid

LABEL = "m int, title string, description string, keywords array<string>"


def test_clean_titles_and_descriptions(spark):
    rows = [(" 'Cluster of: user questions' ", "User questions"), ("cluster of response texts on - cooking", "Cooking"), ("CLUSTER OF ab", "none"), ("cluster on user_prompts: x yz", "X yz"), ("user_prompts cluster on xyz", "Cluster on xyz"), (None, "none"), ("ok?", "Ok?"), ("cluster of cluster on tea pots", "Tea pots")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(X.clean_title(F.col("t"), F.lit("none"))).collect()] == [b for _, b in rows]
    d = spark.createDataFrame([("cluster of responses discussing, the weather",), ("cluster of a b",)], "t string")
    assert [r[0] for r in d.select(X.clean_description(F.col("t"), F.lit("none"))).collect()] == ["The weather", "none"]


def test_generated_labels_fall_back(spark):
    samples = spark.createDataFrame([(k, 0, t) for k, t in ((0, "quiet"), (1, "apples apples"), (2, "bananas"), (3, "cherries"))], "k int, place int, text string")
    seen = []

    def labeler(s):
        seen.append(sorted(r["k"] for r in s.select("k").collect()))
        return s.where("k < 3").selectExpr("k", "if(k = 1, 'Cluster of fruit', 'x') title", "'' description", "if(k = 1, array(' Red '), array()) keywords")

    done = spark.createDataFrame([(3, "kept", "d", ["w"])], LABEL.replace("m int", "k int"))
    got = {r["k"]: r for r in L.label_clusters(samples, done, labeler, generated=True).collect()}
    assert seen == [[1, 2]] and got[0]["keywords"] == ["silent", "low_activation"]
    assert got[1]["title"] == "Fruit" and got[1]["keywords"] == ["red"] and got[1]["description"].startswith("Cluster containing")
    assert got[2]["title"] == "Topic Cluster 2: Bananas" and got[2]["keywords"] == ["bananas"] and got[3]["title"] == "kept"


def test_feature_and_disparity_labels(spark):
    f = spark.createDataFrame([(0, "C", 1, 2.0, 0.5), (0, "R", 1, 1.0, 0.5), (1, "C", 1, 0.5, 0.5), (0, "P", 1, 9.0, 0.5), (2, "C", 7, 0.0, 0.0)], "row_idx long, side string, feature int, max_act double, freq double")
    c = spark.createDataFrame([(1, 1), (7, 2), (8, 3)], "feature int, m int")
    e = spark.createDataFrame([(0, " orange trees ", "grows", None), (1, None, "x" * 500, "y"), (2, "never", "seen", "here")], "row_idx long, prompt string, chosen string, rejected string")
    assert {(r["m"], r["row_idx"]): r["score"] for r in P.activation(f, c).collect()} == {(1, 0): 3.0, (1, 1): 0.5}
    labels = P.feature_labels(f, c, e)
    row = labels.collect()
    assert [r["m"] for r in row] == [1] and len(row[0]["title"]) <= 120 and len(row[0]["description"]) <= 600 and "orange" in row[0]["keywords"]
    resumed = P.feature_labels(f, c, e, spark.createDataFrame([(1, "mine", "d", ["w"])], LABEL)).collect()
    assert [(r["m"], r["title"]) for r in resumed] == [(1, "mine")]
    text = P.sample_texts(spark.createDataFrame([(1, 1, 1)], "m int, row_idx long, rank int"), e, F.lit("H")).first()["text"]
    assert text == "H\nPrompt: \nChosen (Promoted): " + "x" * 160 + "\nRejected (Suppressed): y"
    u = spark.createDataFrame([(0, 1, -0.5), (1, 1, 0.25), (2, 2, 0.0)], "row_idx long, m int, u double")
    both = spark.createDataFrame([(1, "a"), (2, "b")], "m int, title string")
    got = {r["m"]: r for r in P.disparity_labels(both, u, c, e).collect()}
    assert got[1]["title"] == "a" and got[1]["disparity_title"].startswith("Topic Cluster 1: ") and got[2]["disparity_title"] is None
    assert P.feature_labels(f.limit(0), c, e).count() == 0 and P.disparity_labels(both, u.limit(0), c, e).count() == 2


def test_family_examples_fill_with_zeros(spark):
    c = spark.createDataFrame([(4, 1, 0.5), (5, 1, 0.5), (3, 1, 0.75)], "row_idx long, k int, c double")
    e = spark.range(8).select(F.col("id").alias("row_idx"), F.when(F.col("id") < 4, "alpha words").otherwise("gamma").alias("text"))
    top, tokens = P.family_examples(c, "k", "c", spark.createDataFrame([(1,), (2,)], "k int"), e, "text", 4)
    assert [(r["k"], r["row_idx"], r["score"]) for r in top.orderBy("k", "rank").collect()] == [(1, 3, 0.75), (1, 4, 0.5), (1, 5, 0.5), (1, 0, 0.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 0.0)]
    assert [(r["k"], r["token"], r["weight"]) for r in tokens.orderBy("rank").collect()] == [(1, "gamma", 1.0), (1, "alpha", 0.75), (1, "words", 0.75)]
    d = P.family_detail(top, tokens, "k", 1, 2).collect()
    assert [(r["section"], r["place"]) for r in d] == [("example", 1), ("example", 2), ("token", 1), ("token", 2), ("token", 3)]
    assert P.family_detail(top, tokens, "k", 9).count() == 0


def test_clusters_without_a_cell_stay_in_the_grid(spark):
    values = spark.createDataFrame([(i, 1, float(i)) for i in range(8)], "row_idx long, m int, u double")
    members = spark.createDataFrame([(i, 1 + i // 4) for i in range(8)], "row_idx long, k int")
    grid = welch_grid(values, members, pool_size(members), measures=spark.createDataFrame([(1,), (2,)], "m int")).collect()
    assert sorted((r["k"], r["m"], r["delta"], r["z_score"]) for r in grid if r["m"] == 2) == [(1, 2, 0.0, 0.0), (2, 2, 0.0, 0.0)] and len(grid) == 4
    f = spark.createDataFrame([(i, s, 1, 1.0, 0.1 * i) for i in range(20) for s in ("P", "C")], "row_idx long, side string, feature int, max_act double, freq double")
    e = spark.range(20).select(F.col("id").alias("row_idx"))
    pc, rc = (spark.createDataFrame([(1, 1), (2, 2)], f"feature int, {c} int") for c in ("k", "m"))
    got = {(r["k"], r["m"]): r["delta"] for r in V.hypotheses(f, e, pc, rc, 20, 10).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[1, 2] == 0 and got[1, 1] == pytest.approx(1.0) and got[2, 1] == pytest.approx(-1.0)
