"""Iterative estimators: communities of the feature graph, k-means, truncated SVD."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.sources.storage import save, scratch


def _neighbours(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    a, b, x = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    order = np.argsort(a, kind="stable")
    cuts = np.searchsorted(a[order], np.arange(n + 1))
    return [(b[order][i:j], x[order][i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _move(near, own: np.ndarray, degree: np.ndarray, gamma: float, two_m: float, order: np.ndarray, inside: np.ndarray | None = None) -> bool:
    """Local moves until none gains; with `inside`, only within the same part of it. Changes `own`."""
    weight = np.bincount(own, weights=degree, minlength=len(own))
    queue, queued, moved = deque(order), np.ones(len(own), bool), False
    while queue:
        v = queue.popleft()
        queued[v] = False
        to, w = near[v]
        keep = to != v
        if inside is not None:
            keep &= inside[to] == inside[v]
        to, w = to[keep], w[keep]
        if not len(to):
            continue
        parts, index = np.unique(own[to], return_inverse=True)
        link = np.bincount(index, weights=w)
        weight[own[v]] -= degree[v]
        gain = link - gamma * degree[v] * weight[parts] / two_m
        here = np.flatnonzero(parts == own[v])
        stay = gain[here[0]] if len(here) else -gamma * degree[v] * weight[own[v]] / two_m
        best = int(gain.argmax())
        if gain[best] > stay + 1e-12:
            own[v], moved = parts[best], True
            for u in to[own[to] != parts[best]]:
                if not queued[u]:
                    queued[u] = True
                    queue.append(u)
        weight[own[v]] += degree[v]
    return moved


def leiden(src, dst, weight, gamma: float = 1.0, seed: int = 0, rounds: int = 20) -> dict[int, int]:
    """Node -> community (0.. by size, then smallest node), for modularity with resolution gamma: local moves, refinement
    inside each community, aggregation, until nothing changes."""
    nodes, index = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d, w = index[: len(src)], index[len(src) :], np.asarray(weight, float)
    two_m, rng = 2 * w.sum(), np.random.default_rng(seed)
    member, loops, start = np.arange(len(nodes)), np.zeros(len(nodes)), None
    for _ in range(rounds):
        n = len(loops)
        near = _neighbours(n, s, d, w)
        degree = np.array([x[1].sum() for x in near]) + 2 * loops
        own = np.arange(n) if start is None else start.copy()
        moved = _move(near, own, degree, gamma, two_m, rng.permutation(n))
        fine = np.arange(n)
        _move(near, fine, degree, gamma, two_m, rng.permutation(n), inside=own)
        _, fine = np.unique(fine, return_inverse=True)
        if not moved or fine.max() + 1 == n:
            final = own[member]
            break
        start = np.zeros(fine.max() + 1, np.int64)
        start[fine] = own
        _, start = np.unique(start, return_inverse=True)
        new_loops = np.bincount(fine, weights=loops)
        a, b = fine[s], fine[d]
        np.add.at(new_loops, a[a == b], w[a == b])
        a, b, x = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], w[a != b]
        key, index = np.unique(a * (fine.max() + 1) + b, return_inverse=True)
        s, d, w = key // (fine.max() + 1), key % (fine.max() + 1), np.bincount(index, weights=x, minlength=len(key))
        member, loops, final = fine[member], new_loops, start[fine[member]]
    groups = pd.Series(nodes).groupby(final).agg(["size", "min"]).sort_values(["size", "min"], ascending=[False, True])
    name = {c: i for i, c in enumerate(groups.index)}
    return {int(v): name[c] for v, c in zip(nodes, final, strict=True)}


def modularity(src, dst, weight, community: dict[int, int], gamma: float = 1.0) -> float:
    w = np.asarray(weight, float)
    degree: dict[int, float] = {}
    inside = 0.0
    for a, b, x in zip(src, dst, w, strict=True):
        inside += x * (community[a] == community[b])
        for v in (a, b):
            degree[community[v]] = degree.get(community[v], 0.0) + x
    m = w.sum()
    return float(inside / m - gamma * sum((k / (2 * m)) ** 2 for k in degree.values()))


def communities(edges: DataFrame, gamma: float = 1.0, min_size: int = 4, seed: int = 0) -> DataFrame:
    """feature, m: communities of min_size or more, numbered from 1. The graph holds features, whose number the encoder
    bounds, so one task fits it whatever the rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = leiden(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), gamma, seed)
        out = pd.DataFrame({"feature": list(found), "m": list(found.values())}).astype({"feature": "int32", "m": "int32"})
        size = out.groupby("m")["m"].transform("size")
        out = out[size >= min_size].copy()
        out["m"] = out["m"].rank(method="dense").astype("int32")
        return out

    return edges.select("src", "dst", "weight").groupBy(F.lit(1).alias("g")).applyInPandas(fit, "feature int, m int")


def sub_communities(edges: DataFrame, clusters: DataFrame, gamma: float = 1.5, min_size: int = 20, most: int = 10) -> DataFrame:
    """m, feature, sub: communities inside each of the largest clusters; clusters are fitted side by side."""
    size = clusters.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).orderBy(F.desc("n"), "m").limit(most)
    c = clusters.join(F.broadcast(size.select("m")), "m")
    inside = edges.join(F.broadcast(c.select(F.col("feature").alias("src"), "m")), "src").join(F.broadcast(c.select(F.col("feature").alias("dst"), F.col("m").alias("m2"))), "dst").where("m = m2")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = leiden(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), gamma)
        return pd.DataFrame({"m": pdf["m"].iloc[0], "feature": list(found), "sub": list(found.values())})

    return inside.select("src", "dst", "weight", "m").groupBy("m").applyInPandas(fit, "m int, feature int, sub int")


def label_propagation(edges: DataFrame, threshold: float = 0.0, rounds: int = 60) -> DataFrame:
    """feature, root: connected components of edges at or above the threshold (root: smallest feature).

    Each round takes the smallest root among a feature and its neighbours, then that root's own root, so the rounds follow
    the logarithm of the longest chain. Raises if they don't settle.
    """
    spark = edges.sparkSession
    both = edges.where(F.col("weight") >= threshold).select("src", "dst")
    both = save(both.union(both.select("dst", "src")).toDF("a", "b").distinct(), scratch(spark, "propagation-edges"))
    now = both.select(F.col("a").alias("feature"), F.col("a").alias("root")).distinct()
    for _ in range(rounds):
        seen = both.join(now, both["b"] == now["feature"]).groupBy("a").agg(F.min("root").alias("r"))
        step = now.join(seen, now["feature"] == seen["a"]).select("feature", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = step.select(F.col("feature").alias("f2"), F.col("root").alias("r2"))
        nxt = save(step.join(jump, F.col("root") == F.col("f2")).select("feature", F.least("root", "r2").alias("root"), "was"), scratch(spark, "propagation"))
        now = nxt.select("feature", "root")
        if nxt.where("root != was").isEmpty():
            return now
    raise RuntimeError(f"the components did not settle in {rounds} rounds")



def kmeans(vectors: DataFrame, key: str, k: int, seed: int = 0, cosine: bool = True, dims: str = "x") -> DataFrame:
    """key, k (from 1): k-means of vectors(key, x array<double>) by cosine; zero vectors are left out; K at most their number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where(F.exists(dims, lambda x: x != 0)).select(key, array_to_vector(F.col(dims).cast("array<double>")).alias("features"))
    n = v.limit(k).count()
    if n < 2:
        return v.select(key, F.lit(1).alias("k"))
    model = KMeans(k=min(k, n), seed=seed, distanceMeasure="cosine" if cosine else "euclidean").fit(v)
    return model.transform(v).select(key, (F.col("prediction") + 1).alias("k"))


def dense(cells: DataFrame, key: str, column: str, columns: list[int]) -> DataFrame:
    """key, x: array of the values of cells(key, column, x) in the order of `columns`; absent = 0."""
    spot = F.create_map(*(v for i, c in enumerate(columns) for v in (F.lit(c), F.lit(i))))
    packed = cells.where(F.col(column).isin(*columns)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(spot[F.col(column)].alias("i"), F.col("x").cast("double").alias("v")))).alias("mp"))
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.coalesce(F.try_element_at("mp", i), F.lit(0.0))).alias("x"))


def gram(cells: DataFrame) -> DataFrame:
    """i, j, g: products of the feature columns of cells(row_idx, feature, x), the upper triangle."""
    a, b = cells.select("row_idx", F.col("feature").alias("i"), F.col("x").alias("xi")), cells.select("row_idx", F.col("feature").alias("j"), F.col("x").alias("xj"))
    return a.join(b, "row_idx").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("g"))


#: Widest Gram matrix that goes to the driver: 4,096 features are 8.4 million pairs.
WIDEST = 4096


def svd_embedding(cells: DataFrame, rank: int, n_rows: int, widest: int = WIDEST) -> pd.DataFrame:
    """Features x components (left vectors times singular values) of the features-by-rows matrix.

    Up to `widest` features by their Gram matrix, which is summed in Spark; beyond that Spark multiplies the rows with
    vectors and only features x rank numbers go to the driver. Below two components: the Gram rows, or where they are too
    wide the one component.
    """
    names = np.array(sorted(r["feature"] for r in cells.select("feature").distinct().collect()))  # the encoder's width at most
    rank = min(rank, min(len(names), n_rows) - 1)
    if len(names) > widest:
        return _wide_embedding(cells, names, max(1, rank))
    g = gram(cells).toPandas()
    m = np.zeros((len(names), len(names)))
    i, j = np.searchsorted(names, g["i"]), np.searchsorted(names, g["j"])
    m[i, j] = m[j, i] = g["g"]
    if rank < 2:
        return pd.DataFrame(m, index=names)
    value, vector = np.linalg.eigh(m)
    order = np.argsort(-value)[:rank]
    return pd.DataFrame(_signed(vector[:, order]) * np.sqrt(np.maximum(value[order], 0)), index=names)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def _wide_embedding(cells: DataFrame, names: np.ndarray, rank: int) -> pd.DataFrame:
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = cells.sparkSession
    place = F.broadcast(spark.createDataFrame(pd.DataFrame({"feature": names.astype("int64"), "i": np.arange(len(names))})))
    rows = cells.join(place, "feature").groupBy("row_idx").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"))).alias("c"))
    wide = len(names)
    rows = rows.select("c").rdd.map(lambda r: Vectors.sparse(wide, sorted((v["i"], v["x"]) for v in r["c"])))  # a row's firing features
    got = RowMatrix(rows.cache(), numCols=wide).computeSVD(rank)
    return pd.DataFrame(_signed(got.V.toArray()) * got.s.toArray(), index=names)


def row_sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash: the same ones on any partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("row_idx").cast("string"))), "row_idx").limit(n)
