"""Labels of clusters: exemplar samplers, token statistics, clean-up of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import clean_description, clean_title, first_upper

# The words that say nothing of a cluster.
STOP = """
about after again against almost along already also although always among another answer anyone anything around because before
behind being below between beyond cannot could during either enough every except explain first following further given giving
having instead itself little mainly making many might myself neither never nothing number often other others please provide
rather really regarding several should since someone something sometimes still their theirs them themselves there these things
those though through together toward under until using various welcome where whether which while whose within without would
write writing yours assistant human prompt response chosen rejected promoted suppressed
""".split()
#: Runs of anything but white space, Unicode's included.
BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _exploded(df: DataFrame, words: Column, ok) -> DataFrame:
    return df.select("*", F.posexplode(F.filter(words, lambda w: (F.char_length(w) >= 5) & ok(w) & ~w.isin(*STOP))).alias("pos", "token"))


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pos, token: lower-cased runs of letters, digits, _ and ', without quotes at their ends; those of five letters of
    any script or more and nothing else, stop words left out."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    return _exploded(df, F.transform(runs, lambda w: F.trim(w, F.lit("'"))), lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))


def bare_words(text: Column) -> Column:
    """Lower-cased words between white space without punctuation at their ends; empty ones left out."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[^{BLANK}]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.trim(w, F.lit(".,!?;:'\"()"))), lambda w: w != "")


def keyword_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pos, token: lower-cased words between white space without punctuation at their ends, of five characters or more,
    stop words left out."""
    return _exploded(df, bare_words(F.col(text)), lambda w: F.lit(True))


def weighted_tokens(df: DataFrame, key: str, weight: str, n: int = 8) -> DataFrame:
    """key, token, weight, rank: the n tokens of each key with the largest sums of weights."""
    t = df.groupBy(key, "token").agg(F.sum(weight).alias("weight"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "token"))).where(F.col("rank") <= n)


def keywords(df: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """key, token, count, rank: the commonest tokens; ties by first occurrence in `order` and pos."""
    t = df.groupBy(key, "token").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(order, "pos")).alias("first"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first", "token"))).where(F.col("rank") <= n).drop("first")


def centroid_nearest(vectors: DataFrame, assignments: DataFrame, n: int = 30) -> DataFrame:
    """k, row_idx, cosine, rank: rows nearest to the mean of their cluster's unit rows; vectors(row_idx, m, x)."""
    norm = vectors.groupBy("row_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    unit = vectors.join(norm, "row_idx").join(assignments, "row_idx").select("k", "row_idx", "m", (F.col("x") / F.col("norm")).alias("x"))
    size = unit.select("k", "row_idx").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n_k"))
    center = unit.groupBy("k", "m").agg(F.sum("x").alias("c")).join(F.broadcast(size), "k").select("k", "m", (F.col("c") / F.col("n_k")).alias("c"))
    length = center.groupBy("k").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    dot = unit.join(F.broadcast(center), ["k", "m"]).groupBy("k", "row_idx").agg(F.sum(F.col("x") * F.col("c")).alias("dot")).join(F.broadcast(length), "k")
    out = dot.select("k", "row_idx", (F.col("dot") / F.col("length")).alias("cosine"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("cosine", 9)), "row_idx"))).where(F.col("rank") <= n)


def random_members(assignments: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """k, row_idx, rank: n members of each cluster in the order of a hash."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_idx").cast("string")))
    return assignments.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(h, "row_idx"))).where(F.col("rank") <= n)


def _sample_size(sizes: DataFrame, most: int) -> DataFrame:
    """m, want: half of the community's features, four at least and `most` at most."""
    return sizes.groupBy("m").agg(F.count(F.lit(1)).alias("t")).select("m", F.least(F.lit(most), F.greatest(F.lit(4), F.expr("t DIV 2"))).alias("want"))


def decile_sample(scores: DataFrame, clusters: DataFrame, most: int = 30) -> DataFrame:
    """m, row_idx, decile, score, rank: rows from all deciles of the scores above 0, the strongest first.

    A community of t features gets min(most, max(4, t / 2)) rows; each decile, from the lowest, gives its max(1, rows / 10)
    strongest until there are enough; the last decile is closed above. clusters: m, feature.
    """
    scores = scores.where("score > 0")
    cuts = scores.groupBy("m").agg(F.percentile("score", [i / 10 for i in range(1, 10)]).alias("cuts"))
    d = scores.join(cuts, "m").withColumn("decile", F.size(F.filter("cuts", lambda c: F.col("score") >= c))).join(_sample_size(clusters, most), "m")
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("m", "decile").orderBy(F.desc("score"), "row_idx"))).where(F.col("r") <= F.greatest(F.lit(1), F.expr("want DIV 10")))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("m").orderBy("decile", "r"))).where(F.col("place") <= F.col("want"))
    return d.select("m", "row_idx", "decile", "score", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("score"), "row_idx")).alias("rank"))


def top_disparity(scores: DataFrame, clusters: DataFrame, most: int = 8) -> DataFrame:
    """m, row_idx, u, rank: rows by |u|; as many as min(most, max(4, the community's features / 2)). clusters: m, feature."""
    s = scores.where("u <> 0").withColumn("rank", F.row_number().over(Window.partitionBy("m").orderBy(F.desc(F.abs("u")), "row_idx"))).where(F.col("rank") <= most)
    return s.join(_sample_size(clusters, most), "m").where(F.col("rank") <= F.col("want")).select("m", "row_idx", "u", "rank")


SILENT = 0
# The label of the silent rows.
SILENT_TITLE = "Silent Bucket (B_0)"
SILENT_DESCRIPTION = "Examples with low response-side SAE feature activity."
SILENT_KEYWORDS = ["silent", "low_activation"]


def keyword_labels(samples: DataFrame, key: str = "k", order: str = "place", silent: int | None = SILENT) -> DataFrame:
    """key, title, description, keywords of each cluster's sample texts (key, order, text), without a model.

    The five commonest words; the title names the first two, the description the first four. The cluster `silent` holds the
    silent rows and has a label of its own. A cluster without a word has no keyword.
    """
    words = keywords(keyword_tokens(samples).drop("text"), key, order)
    top = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    top = samples.select(key).distinct().join(top, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    title = F.concat(F.lit("Topic Cluster "), F.col(key).cast("string"), F.lit(": "), first_upper(F.array_join(F.slice("keywords", 1, 2), "/")))
    text = F.concat(F.lit("Cluster containing responses associated with "), F.array_join(F.slice("keywords", 1, 4), ", "), F.lit("."))
    quiet = F.lit(False) if silent is None else F.col(key) == silent
    fixed = dict(zip(("title", "description", "keywords"), (F.lit(SILENT_TITLE), F.lit(SILENT_DESCRIPTION), F.array(*map(F.lit, SILENT_KEYWORDS))), strict=True))
    return top.select(key, *(F.when(quiet, fixed[c]).otherwise(x).alias(c) for c, x in (("title", title), ("description", text), ("keywords", F.col("keywords")))))


def label_clusters(samples: DataFrame, done: DataFrame, labeler=None, key: str = "k", fallback=None, generated: bool = False) -> DataFrame:
    """Labels of all clusters: those in `done` stay, the others get theirs from `labeler`, a function of sample rows (key, place,
    text) to rows (key, title, description, keywords); it may call a model by mapInPandas.

    With `generated` its titles and descriptions lose their openings and its keywords are cleaned. What it leaves out or
    returns without a title, and what is too short after the clean-up, comes from `fallback`, by default keyword_labels; then
    the silent rows' cluster never reaches the labeler.
    """
    todo = samples.join(done.select(key).distinct(), key, "left_anti")
    words = (fallback or (lambda d: keyword_labels(d, key)))(todo)
    if labeler is not None and labeler is not fallback:
        made = labeler(todo if fallback else todo.where(F.col(key) != SILENT)).select(key, "title", "description", "keywords").where("coalesce(title, '') <> ''")
        words = merge_labels(clean_labels(made, words, key) if generated else made, words, key)
    return merge_labels(done.select(key, "title", "description", "keywords"), words, key)


def clean_labels(made: DataFrame, fallback: DataFrame, key: str = "k") -> DataFrame:
    """made(key, title, description, keywords) without openings; what is too short then, and missing keywords, as in fallback."""
    other = fallback.select(key, *(F.col(c).alias(f"__{c}") for c in ("title", "description", "keywords")))
    words = clean_keywords(F.col("keywords"))
    return made.join(other, key).select(key, clean_title(F.col("title"), F.col("__title")).alias("title"), clean_description(F.col("description"), F.col("__description")).alias("description"), F.when(F.size(words) > 0, words).otherwise(F.col("__keywords")).alias("keywords"))


def parse_label(text: Column) -> Column:
    """struct(title, description, keywords) from generated text: fences off, the outermost braces, lenient JSON."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^.*?```(?:json)?\s*|```.*$", "")
    body = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "title string, description string, keywords array<string>")
    loose = lambda k: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf'"{k}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return F.struct(F.coalesce(got["title"], loose("title")).alias("title"), F.coalesce(got["description"], loose("description")).alias("description"), clean_keywords(got["keywords"]).alias("keywords"))


def clean_keywords(words: Column, n: int = 5) -> Column:
    """Trimmed, lower-cased, empty ones out, the first n."""
    return F.slice(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != ""), 1, n)


def merge_labels(old: DataFrame, new: DataFrame, key: str = "k") -> DataFrame:
    """Labels that exist stay; new ones join for keys without one."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def examples_text(title: Column, samples: Column, longest: int = 400) -> Column:
    """A labelling prompt: the title and numbered, shortened samples."""
    lines = F.transform(samples, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(s, 1, longest)))
    return F.concat(title, F.lit("\n"), F.array_join(lines, "\n"))
