"""Document fingerprints by winnowing, in DataFrame built-ins only.

A text is lower-cased and cut into units, each white-space token by itself: a token of up to LONG characters into runs of
up to four, a longer one (unspaced scripts, addresses, encoded data, glued words) one character at a time. So units are in
step again after each white space, and inside long tokens at any offset. Every run of K units has a hash, put together from the overlapping hashes of runs half
as long. Of each W hashes in a row the smallest is chosen, of equal ones the rightmost; hash and position share one long,
so a sliding minimum by doubling finds both at once. Texts that share W + K - 1 units in a row share a chosen hash. Inside tokens of over LONG characters
in both texts that holds for any W + K - 1 shared characters; where a shared run begins or ends within a shorter token,
or one text has the run in a shorter token than the other, up to LONG characters at that end may not count.

Scale: all per row; a text's cost is in proportion to its length. With the next document (`with_next`) there is one
exchange of the texts, by ranges of doc_id of equal counts: at most MAX_RANGES bounds are literals of the plan, and the
first document of each range is sent to the range before it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, W = 4, 8  # powers of two
LONG = 16
MAX_RANGES, RANGE_ROWS = 1 << 16, 512
_LAST = (1 << 31) - 1


def _pairs(a: Column, step: int, f) -> Column:
    """f of each element and the one `step` after it; the last `step` elements have none."""
    n = F.size(a) - step
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), f)


def _units(text: Column) -> Column:
    """The units of a text, in order."""
    short = lambda x: F.regexp_extract_all(x, F.lit(r"\S{1,4}"), F.lit(0))
    each = lambda w: F.when(F.char_length(w) > LONG, F.regexp_extract_all(w, F.lit(r"\S"), F.lit(0))).otherwise(short(w))
    mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), each))
    return F.when(F.rlike(text, F.lit(rf"\S{{{LONG + 1}}}")), mixed).otherwise(short(text))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: array of longs, each hash << 31 | (2**31 - 1 - position), in the order of position.

    A text of fewer than K units has one hash of all its units; null, empty or blank text: an empty array. Fewer than W
    hashes make one window. Equal texts have equal fingerprints.
    """
    t = f"__{name}"
    units = _units(F.lower(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(f"{t}_n", F.size(units)).withColumn(t, F.transform(units, lambda u: F.xxhash64(u)))
    few = F.when(F.col(f"{t}_n") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.col(t))))
    step = 1
    while step < K:
        df = df.withColumn(t, F.when(F.col(f"{t}_n") < K, F.col(t)).otherwise(_pairs(F.col(t), step, lambda a, b: F.xxhash64(a, b))))
        step *= 2
    df = df.withColumn(t, F.transform(F.when(F.col(f"{t}_n") < K, few).otherwise(F.col(t)), lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), 31).bitwiseOR(F.lit(_LAST) - i.cast("long"))))
    df = df.withColumn(f"{t}_n", F.size(t))
    step = 1
    while step < W:
        df = df.withColumn(t, F.when(F.col(f"{t}_n") < W, F.col(t)).otherwise(_pairs(F.col(t), step, lambda a, b: F.least(a, b))))
        step *= 2
    one = F.when(F.col(f"{t}_n") == 0, F.col(t)).when(F.col(f"{t}_n") < W, F.array(F.array_min(t))).otherwise(F.array_distinct(t))
    return df.withColumn(name, one).drop(t, f"{t}_n")


def hashes(chosen: Column) -> Column:
    """The chosen hashes without their positions."""
    return F.transform(chosen, lambda v: F.shiftright(v, 31))


def positions(chosen: Column) -> Column:
    """array of struct(hash, position), to find where texts match."""
    return F.transform(chosen, lambda v: F.struct(F.shiftright(v, 31).alias("hash"), (F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST))).cast("int").alias("position")))


def as_string(chosen: Column) -> Column:
    """The hashes in hexadecimal, in the order of position."""
    return F.array_join(F.transform(chosen, lambda v: F.lower(F.hex(F.shiftright(v, 31)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of hashes; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below doc_id (null: none), by binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    padded = F.array(*map(F.lit, bounds)) if len(bounds) < 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    at_most = lambda i: (i <= len(bounds)) & (F.get(padded, i - 1) <= doc_id)
    return F.aggregate(F.array(*(F.lit(1 << s) for s in reversed(range(steps)))), F.lit(0), lambda lo, s: F.when(at_most(lo + s), lo + s).otherwise(lo))


def with_next(docs: DataFrame, chosen: str) -> DataFrame:
    """doc_id, text, fingerprint and next_text, next_fingerprint: those of the next document in ascending doc_id.

    After the last document comes the first. Null doc_id: before all others; repeated doc_id: in the order of the texts.
    A single document is its own next. Empty table: empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = docs.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 10 * ranges)).alias("b")).first()["b"] if ranges > 1 else []
    docs = docs.withColumn("range", _range_of(F.col("doc_id"), sorted(set(bounds or []))))
    first = docs.select("range", "doc_id").groupBy("range").agg(F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("blank")).orderBy("range").collect()  # at most MAX_RANGES rows
    spark, heads = docs.sparkSession, [(None if r["blank"] else r["lo"], first[i - 1]["range"]) for i, r in enumerate(first)]
    heads = spark.createDataFrame(heads, "head long, to int")
    more = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    rows = docs.withColumn("extra", F.lit(False)).unionByName(more).repartition("range")
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    rows = with_fingerprint(rows, "text", chosen)
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn(f"next_{chosen}", F.lead(chosen).over(w)).where("NOT extra").drop("extra", "range")
