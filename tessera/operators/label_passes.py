"""Label passes over response and prompt clusters: sample texts, labels by activation and by disparity, exemplars and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.stats import strip
from tessera.operators import explore as E, labels as L, prompt_view as V
from tessera.operators.features import RESPONSES

PROMPT, RESPONSE = 0.35, 0.40


def activation(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """m, row_idx, score: the summed chosen and rejected maxima of a community's members, where above 0."""
    cells = features.where(F.col("side").isin(*RESPONSES)).join(clusters, "feature")
    return cells.groupBy("m", "row_idx").agg(F.sum("max_act").alias("score")).where("score > 0")


def sample_texts(picked: DataFrame, examples: DataFrame, head: Column, longest: int = 400) -> DataFrame:
    """m, place, text of picked(m, row_idx, rank, ...): the head and the opening of each span, which counts with
    max(80, a share of `longest`) characters. Null spans count as empty."""
    a, b = max(80, int(longest * PROMPT)), max(80, int(longest * RESPONSE))
    part = lambda c, n: F.substring(strip(F.coalesce(F.col(c), F.lit(""))), 1, n)
    text = F.concat(head, F.lit("\nPrompt: "), part("prompt", a), F.lit("\nChosen (Promoted): "), part("chosen", b), F.lit("\nRejected (Suppressed): "), part("rejected", b))
    return picked.join(examples.select("row_idx", "prompt", "chosen", "rejected"), "row_idx").select("m", F.col("rank").alias("place"), text.alias("text"))


def _short(labels: DataFrame) -> DataFrame:
    return labels.select("m", F.left("title", F.lit(120)).alias("title"), F.left("description", F.lit(600)).alias("description"), L.clean_keywords(F.col("keywords")).alias("keywords"))


def feature_labels(features: DataFrame, clusters: DataFrame, examples: DataFrame, done: DataFrame | None = None, labeler=None, most: int = 30, longest: int = 400, generated: bool = False) -> DataFrame:
    """m, title, description, keywords of every community that fires, from rows of all deciles of its activation.

    `done`, `labeler` and `generated` as in label_clusters. Titles have 120 characters at most, descriptions 600. Communities that fire
    nowhere have no label.
    """
    picked = L.decile_sample(activation(features, clusters).withColumn("score", F.round("score", 9)), clusters, most)
    samples = sample_texts(picked, examples, F.format_string("[Activation: %.3f]", F.col("score")), longest)
    return _label(samples, done, labeler, generated)


def disparity_labels(labels: DataFrame, scores: DataFrame, clusters: DataFrame, examples: DataFrame, labeler=None, most: int = 30, longest: int = 400, generated: bool = False) -> DataFrame:
    """labels(m, ...) with disparity_title, disparity_description, disparity_keywords from the rows with the largest |u| of
    scores(row_idx, m, u). They are null for a community without any row where u isn't 0."""
    picked = L.top_disparity(scores, clusters, most)
    samples = sample_texts(picked, examples, F.format_string("[Disparity: u=%+.3f]", F.col("u")), longest)
    made = _label(samples.join(F.broadcast(labels.select("m")), "m", "left_semi"), None, labeler, generated)  # one row a community
    return labels.join(made.select("m", *(F.col(c).alias(f"disparity_{c}") for c in ("title", "description", "keywords"))), "m", "left")


def _label(samples: DataFrame, done: DataFrame | None, labeler, generated: bool) -> DataFrame:
    words = lambda s: L.keyword_labels(s, "m", silent=None)
    if done is None:
        done = samples.sparkSession.createDataFrame([], "m int, title string, description string, keywords array<string>")
    made = L.label_clusters(samples, done, labeler, "m", words, generated)
    return _short(made)


def family_examples(values: DataFrame, key: str, value: str, groups: DataFrame, examples: DataFrame, text: str, n: int = 5, n_tokens: int = 8) -> tuple[DataFrame, DataFrame]:
    """Exemplars (key, row_idx, rank, score) and tokens (key, token, weight, rank) of every group of `groups`.

    The n rows with the largest value of each group stand for it; rows without a cell fill up with 0, the smallest row_idx
    first. Tokens are those of their texts, weighted by the rows' values; a row without a value gives none.
    """
    c = values.select("row_idx", F.col(key).alias("k"), F.col(value).alias("c"))
    top = V.top_expressers(c, examples, n, groups=groups.select(F.col(key).alias("k")).distinct())
    top = top.join(c.where("c > 0").withColumnRenamed("c", "score"), ["k", "row_idx"], "left").fillna(0.0, ["score"])
    words = L.tokens(top.where("score > 0").join(examples.select("row_idx", F.col(text).alias("text")), "row_idx")).drop("text")
    tokens = L.weighted_tokens(words, "k", "score", n_tokens)
    return top.select(F.col("k").alias(key), "row_idx", "rank", "score"), tokens.withColumnRenamed("k", key)


def family_detail(exemplars: DataFrame, tokens: DataFrame, key: str, cluster: int, n: int = 5) -> DataFrame:
    """section, place, row_idx, token, x of one prompt or response cluster: its first n exemplars and its tokens, from the
    saved tables of family_examples. A cluster that isn't there has no row."""
    e = exemplars.where((F.col(key) == cluster) & (F.col("rank") <= n))
    e = e.select(F.lit("example").alias("section"), F.col("rank").cast("int").alias("place"), "row_idx", F.lit(None).cast("string").alias("token"), F.col("score").cast("double").alias("x"))
    t = tokens.where(F.col(key) == cluster)
    return e.unionByName(t.select(F.lit("token").alias("section"), F.col("rank").cast("int").alias("place"), F.lit(None).cast("long").alias("row_idx"), "token", F.col("weight").cast("double").alias("x")))


def ranked_examples(features: DataFrame, scores: DataFrame, clusters: DataFrame, m: int, n: int = 12, sort: str = "activation") -> DataFrame:
    """row_idx, x, place: the n best rows of a community by activation or, with sort='disparity', by |u|; only those above 0."""
    if sort == "disparity":
        hit = scores.where(F.col("m") == m).select("row_idx", F.abs("u").alias("x"))
    else:
        hit = activation(features, clusters.where(F.col("m") == m)).select("row_idx", F.col("score").alias("x"))
    return E.top_per(hit.where("x > 0").withColumn("__one", F.lit(1)), "__one", [F.desc(F.round("x", 9)), F.col("row_idx")], n, "place").drop("__one")


def catalog_order(labels: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """labels(m, title, ...) with has_hypotheses, those with a hypothesis first, then by m; a missing title becomes T_m."""
    known = hypotheses.select("m").distinct().withColumn("has_hypotheses", F.lit(True))
    out = labels.join(known, "m", "left").fillna(False, ["has_hypotheses"])
    out = out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("T_"), F.col("m").cast("string"))))
    return out.orderBy(F.desc("has_hypotheses"), "m")


def condition_counts(scores: DataFrame, conditions: list[tuple[int, str, float]]) -> DataFrame:
    """m, direction, n_total: how many rows each condition matches by itself; 0 for an unknown community."""
    wanted = scores.sparkSession.createDataFrame(sorted({(m, d) for m, d, _ in conditions}), "m int, direction string")
    hit = scores.where("u <> 0").select("m", F.when(F.col("u") > 0, "amplify").otherwise("suppress").alias("direction"))
    hit = hit.join(F.broadcast(wanted), ["m", "direction"]).groupBy("m", "direction").agg(F.count(F.lit(1)).alias("n_total"))
    return wanted.join(hit, ["m", "direction"], "left").fillna(0, ["n_total"])


def condition_members(clusters: DataFrame, conditions: list[tuple[int, str, float]]) -> DataFrame:
    """feature: the members of all communities that the conditions name, once each."""
    return clusters.where(F.col("m").isin(*{m for m, _, _ in conditions})).select("feature").distinct()
