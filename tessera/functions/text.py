"""Column expressions of text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.stats import strip

# Openings that generated titles and descriptions lose, in the order in which they are tried.
TITLE_OPENINGS = (
    "cluster of response texts on", "cluster of response texts", "cluster of user prompts on", "cluster of user prompts", "cluster of",
    "cluster on", "labeling clusters of", "labeling cluster of", "user_prompts", "response_texts",
)
DESCRIPTION_OPENINGS = (
    "cluster of response texts discussing", "cluster of response texts related to", "cluster of response texts on",
    "cluster of responses related to", "cluster of responses discussing", "cluster of user prompts asking about",
    "cluster of user prompts related to", "cluster responses based on", "cluster containing responses associated with", "cluster of",
)
TO_END = 1 << 30


def first_upper(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, TO_END))


def without_openings(text: Column, openings: tuple[str, ...], least: int, fallback: Column) -> Column:
    """Text without quotes around it and without the openings, which are tried once each in order; its first letter in upper
    case. `fallback` where fewer than `least` characters are left. Null counts as empty."""
    bare = F.btrim(strip(F.coalesce(text, F.lit(""))), F.lit("\"'"))
    cut = lambda t, p: F.when(F.startswith(F.lower(t), p), F.btrim(F.substring(t, F.char_length(p) + 1, F.lit(TO_END)), F.lit(" :-,"))).otherwise(t)
    left = F.aggregate(F.array(*map(F.lit, openings)), bare, cut)
    return F.when(F.char_length(left) >= least, first_upper(left)).otherwise(fallback)


def clean_title(text: Column, fallback: Column) -> Column:
    return without_openings(text, TITLE_OPENINGS, 3, fallback)


def clean_description(text: Column, fallback: Column) -> Column:
    return without_openings(text, DESCRIPTION_OPENINGS, 5, fallback)


def card_set(repo: Column, sae_id: Column, path: Column, layer: Column, k: Column) -> Column:
    """struct(model, sae) that names the public feature cards of an encoder; null for one without cards. Nulls in repo, id or
    path count as empty, a null layer as 14, a null k as 80."""
    repo, sae_id, path = (F.lower(F.coalesce(c, F.lit(""))) for c in (repo, sae_id, path))
    layer, k = F.coalesce(layer, F.lit(14)).cast("string"), F.coalesce(k, F.lit(80)).cast("string")
    has = F.contains
    first = has(repo, F.lit("qwen3")) | has(path, F.lit("qwen3")) | has(sae_id, F.lit("qwen_qwen3"))
    second = has(repo, F.lit("gemma-scope")) | has(repo, F.lit("gemma-2-2b")) | has(repo, F.lit("canonical")) | has(path, F.lit("gemma"))
    kind = F.when(has(repo, F.lit("mlp")), "-gemmascope-mlp-16k").otherwise("-gemmascope-res-16k")
    return F.when(first, F.struct(F.lit("qwen3-1.7b").alias("model"), F.concat(layer, F.lit("-resid-batchtopk-65k__l0-"), k).alias("sae"))).when(second, F.struct(F.lit("gemma-2-2b").alias("model"), F.concat(layer, kind).alias("sae")))
