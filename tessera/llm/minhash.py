"""Near-duplicate detection with HyperMinHash sketches, banding, estimation and verification on full sets.

A document is the set of its distinct word shingles (64-bit hashes). Its sketch has one register for each of `buckets`
buckets: a shingle's hash picks the bucket, and the bucket keeps, for its smallest hash, the number of leading zeros and
ten bits after them, in 16 bits. Equal sets become one class before anything else; only class representatives go on.

1. Bands. Each band reads `rows` registers. An empty register takes, for banding only, the register of the first
   non-empty bucket in a fixed random order of its own, which keeps the chance of a match at the Jaccard index. 64 bands
   of 7 of 256 registers missed none of 5,000 simulated pairs at 0.8 of 18, 27 and 45 shingles each, and rarely below
   0.4 meet. Very small sets are missed far more often, so where the smaller set has up to SMALL shingles a pair also
   shares an exact key (exact_keys): these make buckets like those of the bands.
2. Stars. In each bucket of two or more, every document is paired only with the bucket's hub. A bucket's hub gives way to
   the best hub that it meets and resembles (hub_stars), so a family of copies has one hub or a few, and pairs grow with the
   rows, not with the square of a bucket.
3. Check. Pairs whose collision-corrected estimate is far below the threshold go; the others are verified on full sets,
   as differences from the hub.
4. Rest. Links make components. Documents of different components that share a bucket also share its hub; how each differs
   from it tells exactly whether they are linked, and that any link needs common shingles among those differences
   (_across): pairs come from the rarest of them (prefix filter, by each pair's own bound) and are decided by them. Before
   that, documents with such a shingle in common are compared with one of them, which joins those that resemble each
   other but not the hub. No link between documents that share a bucket is left out, and a family of copies that differ
   too much gives few pairs.
5. Components by hooking to smaller neighbours and contracting, each round cut by a written table.

Classes of equal sets are named by numbers of their own, so a doc_id that stands for several texts loses no link; doc_ids
come back only when the components are known.

Scale: texts are shuffled once (only candidates' texts come back for verification), band rows have 16 bytes, small sets have
up to five more, hot buckets collapse before the shuffle and are joined to one hub row, whose large side Spark splits; a
hub's text moves once for each MEMBERS of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.llm.common import FILE, ROW, Tables, located, prepare, without

MANTISSA = 10
BUCKETS, BANDS, ROWS = 256, 64, 7
SMALL = 16
SEED = 20_240_229
LIKE, MEMBERS = 0.5, 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words: the whole sequence as one; none: empty."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sketch(shingles: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Registers: (leading zeros + 1) << 10 | the ten bits after the leading one, of each bucket's smallest; 0: empty."""
    out = np.zeros(buckets, np.uint16)
    if not len(shingles):
        return out
    h = mix(shingles ^ np.uint64(SEED))
    shift = buckets.bit_length() - 1
    where, rest = (h & np.uint64(buckets - 1)).astype(np.int64), h >> np.uint64(shift)
    low = np.full(buckets, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, where, rest)
    full = low != np.iinfo(np.uint64).max
    v, width = np.maximum(low[full], np.uint64(1)), 64 - shift
    top = np.frexp(v.astype(np.float64))[1] - 1  # the highest bit; rounding up at a power of two is put right below
    top -= (v >> np.minimum(top, 63).astype(np.uint64)) == 0
    zeros = width - 1 - top
    drop = np.maximum(top - MANTISSA, 0).astype(np.uint64)
    bits = (v >> drop) & np.uint64((1 << MANTISSA) - 1)
    out[full] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | bits).astype(np.uint16)
    return out


_orders: dict[int, np.ndarray] = {}


def fill(registers: np.ndarray) -> np.ndarray:
    """Rows of registers with empty ones filled for banding."""
    n = registers.shape[1]
    if n not in _orders:
        _orders[n] = np.random.default_rng(SEED).integers(0, n, size=(64, n))
    out = registers.copy()
    empty = out == 0
    for order in _orders[n]:
        if not empty.any():
            return out
        take = registers[:, order]
        out = np.where(empty, take, out)
        empty = out == 0
    for r in np.flatnonzero(empty.any(axis=1)):  # few shingles: go on with one order until a full one is met
        full = np.flatnonzero(registers[r])
        if len(full):
            walk = np.random.default_rng(SEED + 1).permutation(n)
            place = {b: i for i, b in enumerate(walk)}
            for j in np.flatnonzero(empty[r]):
                out[r, j] = registers[r, min(full, key=lambda b: (place[b] - place[j]) % n)]
    return out


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each row of registers, one 64-bit key a band."""
    rng, n = np.random.default_rng(SEED + 2), registers.shape[1]
    pool = np.concatenate([rng.permutation(n) for _ in range(-(-bands * rows // n))])[: bands * rows].reshape(bands, rows)
    got = fill(registers)[:, pool].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), got.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + got[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the collisions expected of unequal elements.

    With u and v elements a bucket, the smallest hashes (as numbers in 0..1) have densities u exp(-u x) and v exp(-v x).
    Octave j, from 2**-j to 2**(1-j), has 2**MANTISSA cells of width 2**-(j + MANTISSA), so unequal ones fall in one cell
    with the chance sum over j of width * u v / (u + v) * (exp(-(u+v) 2**-j) - exp(-(u+v) 2**(1-j))), here among the
    buckets that either set uses; matches m of k used buckets give (m / k - c) / (1 - c).
    """
    used = (a != 0) | (b != 0)
    k = np.maximum(used.sum(axis=1), 1)
    match = ((a == b) & used).sum(axis=1) / k
    u, v = (np.maximum(np.asarray(n, np.float64), 1e-9) / a.shape[1] for n in (na, nb))
    edge = 2.0 ** -np.arange(0, 65 - a.shape[1].bit_length())
    lost = np.exp(-(u + v)[:, None] * edge[None, :])
    c = (u * v / (u + v)) * ((lost[:, 1:] - lost[:, :-1]) * edge[1:] / (1 << MANTISSA)).sum(axis=1) / -np.expm1(-(u + v))
    return np.clip((match - c) / (1 - c), 0, 1)


def exact_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a small set: two unequal sets at the threshold, the smaller of up to SMALL shingles, share one.

    Of n sorted hashes the first n - ceil(p n) + 1 are a prefix that a set with the needed overlap can't avoid. A set too
    small to have an unequal partner at the threshold, or larger than any partner of a small set, has none.
    """
    n = len(shingles)
    if n * percent > 100 * SMALL or 100 * n < percent * (n + 1):
        return np.empty(0, np.int64)
    return mix(shingles[: n - -(-percent * n // 100) + 1] + np.uint64(SEED)).view(np.int64)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(*x) for x in fields.items()])


LONG = T.LongType()


def sketch_documents(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, FILE, ROW, n (set size), d1, d2 (128-bit digest of the set), regs (binary), small (exact_keys, binary)."""
    docs = docs.select("doc_id", FILE, ROW, "text")
    schema = T.StructType([*docs.schema.fields[:3], *_schema(n=LONG, d1=LONG, d2=LONG, regs=T.BinaryType(), small=T.BinaryType())])

    def run(batches):
        import xxhash

        for b in batches:
            n, d, regs, small = [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                regs.append(sketch(s).tobytes())
                small.append(exact_keys(s, percent).tobytes())
            d = np.array(d, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(regs, pa.binary()), pa.array(small, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def band_rows(reps: DataFrame) -> DataFrame:
    """bucket, rep: one row a band of each representative, and one an exact key of small sets."""
    schema = _schema(bucket=LONG, rep=LONG)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                regs = np.frombuffer(b"".join(some.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                keys = band_keys(regs)
                small = [np.frombuffer(x, np.int64) for x in some.column("small").to_pylist()]
                rep = some.column("rep").to_numpy(zero_copy_only=False)
                keys, rep = np.concatenate([keys.ravel(), *small]), np.concatenate([np.repeat(rep, keys.shape[1]), np.repeat(rep, [len(x) for x in small])])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep)], names=schema.names)

    return reps.select("rep", "regs", "small").mapInArrow(run, schema)


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with `likely`: the estimate isn't far below the threshold (six standard deviations of the registers
    used) and the sizes allow it."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    schema = _schema(a=LONG, b=LONG, likely=T.BooleanType())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            used = np.maximum(((ra != 0) | (rb != 0)).sum(axis=1), 1)
            cut = threshold - 6 * np.sqrt(threshold * (1 - threshold) / used)
            ok = (estimate(ra, rb, na, nb) >= cut) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=schema.names)

    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, schema)


def hub_stars(t: Tables, live: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b), each once: in every bucket all documents but the hub are paired with the hub.

    A bucket's hub is first the document that meets most others over all its bands. Every document looks up to the best
    hub that it shares a bucket with, and a bucket's hub gives way to the one it looks up to while the estimate says that
    they resemble each other (at least LIKE), up to four times. So a family has one hub or a few, not one a bucket, and
    all documents of a bucket still have one hub in common.
    """
    degree = live.groupBy("rep").agg(F.sum(F.col("c") - 1).alias("degree"))
    first = t.save(live.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("m"))).alias("h")).select("bucket", "h.degree", (-F.col("h.m")).alias("hub")), "hubs")
    up = live.join(first, "bucket").groupBy("rep").agg(F.max(F.struct("degree", (-F.col("hub")).alias("m"))).alias("h")).select("rep", (-F.col("h.m")).alias("up"))
    hubs = first.select("hub").distinct()
    steps = hubs.join(up, F.col("hub") == F.col("rep")).where("hub != up").select(F.col("hub").alias("a"), F.col("up").alias("b"))
    lift = t.save(estimated(steps, reps, LIKE).where("likely").select(F.col("a").alias("hub"), F.col("b").alias("to")), "lift")
    for i in (1, 2):
        again = lift.toDF("mid", "far")
        lift = t.save(lift.join(again, F.col("to") == F.col("mid"), "left").select("hub", F.coalesce("far", "to").alias("to")), f"lift-{i}")
    last = first.join(lift, "hub", "left").select("bucket", F.coalesce("to", "hub").alias("a"))
    return live.select("bucket", "rep").join(last, "bucket").where("rep != a").select("a", F.col("rep").alias("b")).distinct()


def differences(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """How each b differs from its hub a, on full sets: a, b, n (b's size), diff (the shingles that only one of them has)
    and link (100 * intersection >= percent * union).

    A hub's text moves once for each MEMBERS of its pairs: members are dealt by hub and part, and the hub's row comes first.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    hubs = size.join(texts, F.col("a") == F.col("rep")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.select("a", "b").join(size, "a").join(texts, F.col("b") == F.col("rep")).select("a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("deal"), "b", "text")
    rows = hubs.unionByName(members).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())
    schema = _schema(a=LONG, b=LONG, n=LONG, diff=T.ArrayType(LONG), link=T.BooleanType())

    def run(batches):
        hub = None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                s = shingle_set(text, width)
                if b is None:
                    hub = s
                    continue
                diff = np.setxor1d(hub, s, assume_unique=True)
                out.append((a, b, len(s), diff.view(np.int64), 100 * (len(hub) + len(s) - len(diff)) >= percent * (len(hub) + len(s) + len(diff))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=schema.names)

    return rows.select("a", "b", "text").mapInArrow(run, schema)


def components(t: Tables, links: DataFrame, label: str) -> DataFrame:
    """node, root for every node of the links (a, b): root is the smallest node reachable.

    Rounds of: each node moves to the smallest of itself and its neighbours, then to where that one moves; links between
    nodes that have met go, the others are carried over to where their ends went. At least every second node of a
    component goes in a round, and a round is cut by written tables.
    """
    ends = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a != b").distinct()
    edges, root = t.save(ends(links, "a", "b"), f"{label}-edges"), None
    for i in range(64):
        if root is not None and edges.isEmpty():
            return root
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        one = t.save(near.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), f"{label}-near-{i}")
        move = t.save(one.join(one.toDF("mid", "far"), F.col("to") == F.col("mid")).select("node", F.col("far").alias("to")), f"{label}-move-{i}")
        edges = t.save(ends(edges.join(move.toDF("a", "x"), "a").join(move.toDF("b", "y"), "b"), "x", "y"), f"{label}-edges-{i}")
        if root is None:
            root = move.toDF("node", "root")
        else:
            root = t.save(root.join(move.toDF("mid", "far"), F.col("root") == F.col("mid"), "left").select("node", F.coalesce("far", "root").alias("root")), f"{label}-root-{i}")
    raise RuntimeError("the components did not settle in 64 rounds")


def _across(t: Tables, seen: DataFrame, percent: int) -> DataFrame:
    """Links between components: pairs of members of one hub's family with different roots, by those roots.

    With D(x) the shingles that x and the hub don't share, x and y differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so they
    are linked if and only if 2 (100 + p) |D(x) & D(y)| >= e(x) + e(y), where e(x) = (100 + p) |D(x)| - (100 - p) |x|.
    The hub has the smallest e, so members it isn't linked with need a common shingle in D for any link. How many x needs
    at least (`need`) follows from the smallest e of a member with another root, and from the largest partner's size;
    then |D(x)| - need + 1 of them, the rarest in the family, can't all be missed (prefix filter).

    Members that share an offered shingle are first compared with one of them only, so that those who resemble each other
    but not the hub make one component by as many pairs as offers. What is left meets in all its pairs: x and y need
    `both` common shingles, so the first of them is among the |D| - both + 1 rarest of either, and the second (where both
    sides offer it) one place further at most. Pairs with fewer common ones at such places are not linked.
    """
    p, q = F.lit(100 + percent), F.lit(100 - percent)
    dn, e = F.size("diff").cast("long"), p * F.size("diff") - q * F.col("n")
    seen = t.save(seen.withColumn("e", e).withColumn("dn", dn), "family")
    least = seen.groupBy("a").agg(F.min("e").alias("e_all"), F.min(F.when(F.col("root") != F.col("hub_root"), F.col("e"))).alias("e_far"), F.max("n").alias("n_most"))
    other = F.when(F.col("root") == F.col("hub_root"), F.col("e_far")).otherwise(F.col("e_all"))
    partner = F.least(F.floor(F.lit(100) * F.col("n") / F.lit(percent)), F.col("n_most"))
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + other) / (2 * p)), F.ceil((p * F.col("dn") - q * (F.col("n") + partner)) / p))
    each = seen.join(least, "a").withColumn("need", need).where("need <= dn").select("a", "b", "n", "root", "e", "dn", "need", F.explode("diff").alias("key"))
    common = each.groupBy("a", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    each = each.join(common, ["a", "key"], "left").withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("c", F.lit(1)), "key")))
    each = t.save(each.where("r <= dn - need + 1 AND c > 1").select("a", "b", "n", "root", "e", "dn", "need", "r", "key"), "offers")
    fits = (F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")) & (2 * p * F.least("dn", "dn2") >= F.col("e") + F.col("e2"))

    def linked(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(seen.select("a", "b", "diff", "e", "root"), ["a", "b"]).join(seen.select("a", F.col("b").alias("b2"), F.col("diff").alias("diff2"), F.col("e").alias("e2"), F.col("root").alias("root2")), ["a", "b2"])
        return sides.where(2 * p * F.size(F.array_intersect("diff", "diff2")) >= F.col("e") + F.col("e2")).select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct()

    one = each.groupBy("a", "key").agg(F.min(F.struct("e", "b", "n", "root", "dn")).alias("h")).select("a", "key", *(F.col(f"h.{x}").alias(f"{x}2") for x in ("e", "b", "n", "root", "dn")))
    links = t.save(linked(each.join(one, ["a", "key"]).where((F.col("root") != F.col("root2")) & fits).select("a", "b", "b2").distinct()), "near-links")
    if not links.isEmpty():
        moved = components(t, links, "cc-family").toDF("root", "top")
        each = t.save(each.join(moved, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "offers-left")
    again = each.select("a", *(F.col(x).alias(f"{x}2") for x in ("b", "n", "root", "e", "dn", "need", "r")), "key")
    both = F.greatest(F.ceil((F.col("e") + F.col("e2")) / (2 * p)), "need", "need2")
    early = F.least(F.col("dn") - F.col("r"), F.col("dn2") - F.col("r2")) + 2 >= both
    shared = F.least(F.lit(2), both - F.greatest("need", "need2") + 1)
    met = each.join(again, ["a", "key"]).where((F.col("root") < F.col("root2")) & fits & early).groupBy("a", "b", "b2").agg(F.count(F.lit(1)).alias("c"), F.max(shared).alias("shared")).where("c >= shared")
    pairs = t.save(met.groupBy("b", "b2").agg(F.min("a").alias("a")), "across")
    return links.union(linked(pairs)).distinct()


def _near(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_dedup of a located frame; also `first`: the one row that stays of a group (all rows without a shingle or id)."""
    spark = docs.sparkSession
    t = Tables(spark, "near")
    all_docs = t.save(sketch_documents(docs, width, percent), "sketch")
    some = all_docs.where("n > 0 AND doc_id IS NOT NULL")
    same = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", FILE, ROW)).alias("place"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("small").alias("small"))
    reps = t.save(same.withColumn("rep", F.monotonically_increasing_id()), "reps")  # written, so the number stays

    rows = band_rows(reps)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    live = t.save(rows.join(counts, "bucket"), "live")
    stars = t.save(estimated(t.save(hub_stars(t, live, reps), "stars"), reps, percent / 100), "likely")
    t.remove("live", "hubs", "stars")
    ids = stars.select(F.col("a").alias("rep")).union(stars.select(F.col("b").alias("rep"))).distinct()
    where = ids.join(reps.select("rep", F.col(f"place.{FILE}").alias(FILE), F.col(f"place.{ROW}").alias(ROW)), "rep")
    texts = t.save(docs.select(FILE, ROW, "text").join(where, [FILE, ROW]).select("rep", "text"), "texts")
    checked = t.save(differences(stars.where("likely"), texts, width, percent), "checked")

    links = checked.where("link").select("a", "b").unionByName(_repeated_ids(some, reps))
    comp = components(t, links, "cc")
    named = lambda df, c: df.join(comp.toDF(c, f"root_{c}"), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    family = named(named(stars, "a"), "b")
    mixed = family.groupBy("a").agg(F.count_if(F.col("root_a") != F.col("root_b")).alias("other")).where("other > 0").select("a")
    family = t.save(family.join(mixed, "a").select("a", "b", "likely", F.col("root_a").alias("hub_root"), F.col("root_b").alias("root")), "mixed")
    more = t.save(differences(family.where("NOT likely"), texts, width, percent), "unlike")
    seen = checked.unionByName(more).join(family.drop("likely"), ["a", "b"])
    extra = t.save(_across(t, seen, percent), "extra")
    if not extra.isEmpty():
        roots = components(t, extra, "cc2").toDF("mid", "top")
        comp = comp.join(roots, F.col("root") == F.col("mid"), "full").select(F.coalesce("node", "mid").alias("node"), F.coalesce("top", "root").alias("root"))

    comp = comp.join(reps.select("rep", "place"), F.col("node") == F.col("rep")).select("node", "root", "place")
    least = comp.groupBy("root").agg(F.min("place").alias("stays"))
    comp = comp.join(least, "root").select("node", "stays")
    named = t.save(reps.select("rep", "d1", "d2", "place").join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("stays", "place").alias("stays")), "named")
    t.remove(*(x for x in t.paths if x not in ("sketch", "named")))
    own = all_docs.select("doc_id", FILE, ROW, "n", *(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(d)).alias(d) for d in ("d1", "d2")))
    root, kept = F.col("stays.doc_id"), F.col("doc_id") == F.col("stays.doc_id")
    first = kept & (F.col(FILE) == F.col(f"stays.{FILE}")) & (F.col(ROW) == F.col(f"stays.{ROW}"))
    known = own.where("d1 IS NOT NULL").join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), kept.alias("kept"), FILE, ROW, first.alias("first"))
    alone = own.where("d1 IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), FILE, ROW, F.lit(True).alias("first"))
    return known.unionByName(alone)


def _repeated_ids(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes that have a doc_id in common: one id with different texts is one document."""
    twice = some.groupBy("doc_id").agg(*(f(d).alias(f"{f.__name__}_{d}") for d in ("d1", "d2") for f in (F.min, F.max))).where("min_d1 != max_d1 OR min_d2 != max_d2").select("doc_id")
    own = some.join(twice, "doc_id").select("doc_id", "d1", "d2").distinct().join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a != b")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, FILE, ROW (the locator), first.

    Words are runs of anything but ASCII white space, A-Z in lower case. Documents are linked when 100 * intersection >=
    percent * union of their shingle sets; component_id is the smallest doc_id reachable and kept says that it is the
    row's own. Fewer words than `width`: the whole sequence is one shingle. Null or empty text, or no word: an empty set,
    linked with nothing, kept. Null doc_id: it takes part in no link, has a null component_id and is kept. Rows that
    repeat a doc_id are one document, whatever their texts, each with the links of its own text; `first` marks one row of
    a group. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    return _near(located(docs, "near-docs", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent)


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; all columns stay as they are."""
    prepare(docs.sparkSession)
    return without(docs, "near-in", lambda rows: _near(rows.withColumn("doc_id", F.col("doc_id").cast("long")), width, percent).where("NOT first"))
