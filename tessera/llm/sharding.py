"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Count the rows of every input file (one row a file goes to the driver). A file is a partition here: how a scan cuts
   files into tasks depends on the cores at hand, a row's place in its file doesn't.
2. Draw the matrix file x shard from the multivariate hypergeometric law: its row sums are the files' counts, its column
   sums the shards' exact sizes. This is the law that a uniform shuffle of all rows would give.
3. Each file permutes its rows by a keyed permutation of their places (four-round Feistel network with cycle walking):
   the first m[file, 0] go to shard 0, the next m[file, 1] to shard 1, and so on. This needs no state, so a task that runs
   again, on whatever part of a file, deals as before.
4. The j-th row that a file sends to shard s has the number offset[file, s] + j among the shard's arrivals. A keyed
   permutation of 0..size-1 turns it into the row's slot: the second permutation, with no sort and no task per shard.
5. Rows are exchanged by (shard, slot) range, so each output file holds a run of slots of a shard.

Scale: one exchange of the rows; the matrix has 8 bytes x files x shards (32 MB for 100,000 files and 40 shards), twice,
and doesn't depend on the rows. Hot keys don't matter: the law looks at no column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import FILE, ROW, located, prepare, save, scratch

_M64 = (1 << 64) - 1
URN = 1_000_000_000  # numpy's samplers take smaller urns only


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows: files. Columns: shards, whose sizes are at most one apart.

    The files are halved again and again; what the first half sends to each shard is one multivariate hypergeometric draw
    from what both send, so only the first few draws are from large urns.
    """
    total = int(sum(counts))
    n = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), shards), dtype=np.int64)
    todo = [(0, len(counts), np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64))]
    while todo:
        lo, hi, sent = todo.pop()
        if hi - lo == 1:
            out[lo] = sent
        elif hi > lo:
            mid = (lo + hi) // 2
            first = multivariate(rng, sent, int(n[mid] - n[lo]))
            todo += [(lo, mid, first), (mid, hi, sent - first)]
    return out


def multivariate(rng: np.random.Generator, urn: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour n draws without replacement take."""
    left = int(urn.sum())
    if left < URN:
        return rng.multivariate_hypergeometric(urn, n, method="marginals")
    out = np.zeros_like(urn)
    for s, good in enumerate(urn.tolist()):
        left -= good
        out[s] = x = hypergeometric(rng, good, left, n)
        n -= x
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, for urns of any size.

    Taking every ball with the chance n / (good + bad) takes about n of them, and given how many, any set of that size is as
    likely. If it was too many, some of them go back, drawn uniformly from those taken; if too few, the rest is drawn from
    what is left. Either is about sqrt(n) draws, so a few rounds do, and the law is exact.
    """
    if 2 * n > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - n)
    x = 0
    while n and good and bad:
        if good + bad < URN:
            return x + int(rng.hypergeometric(good, bad, n))
        if n <= 8:
            hit = int(rng.integers(good + bad) < good)
            x, good, bad, n = x + hit, good - hit, bad - 1 + hit, n - 1
            continue
        some, other = int(rng.binomial(good, n / (good + bad))), int(rng.binomial(bad, n / (good + bad)))
        if some + other > n:
            return x + some - hypergeometric(rng, some, other, some + other - n)
        x, good, bad, n = x + some, good - some, bad - other, n - some - other
    return x + (n if good else 0)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(i: np.ndarray, size: int, key: int) -> np.ndarray:
    """A bijection of 0..size-1, applied to i."""
    if size <= 1:
        return i.astype(np.int64)
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_mix(right, (key * 4 + r + 1) * 0x2545F4914F6CDD1D & _M64) & mask)
        x[todo] = left << np.uint64(half) | right
        todo[todo] = x[todo] >= np.uint64(size)
    return x.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """All rows and columns of docs with `_shard` int and `_slot` long, laid out by shard and slot.

    Shard sizes are at most one apart and slots run from 0 without gaps. Rows count one by one: nulls, empty or very
    long texts, ties and repeated rows make no difference. Fewer rows than shards: the later shards are empty. Empty
    table: empty result. A column of docs named `_shard` or `_slot` is replaced. A frame that isn't whole files is written
    to the shared folder first.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("_shard", "_slot")
    names = "_shard", "_slot"  # the place of a row stands in their columns until it is dealt

    def counted(rows):
        got = rows.groupBy(names[0]).agg(F.count(F.lit(1)).alias("n"), F.max(names[1]).alias("last")).orderBy(names[0]).collect()
        return [r[0] for r in got], [r["n"] for r in got], all(r["last"] + 1 == r["n"] for r in got)

    rows = located(docs, "shard-in", names=names)
    files, counts, whole = counted(rows)
    if not whole:  # filters left gaps
        rows = located(save(docs, scratch(spark, "shard-in")), "shard-in", names=names)
        files, counts, _ = counted(rows)
    matrix = communication_matrix(counts, shards, seed)
    plan = spark.sparkContext.broadcast(({f: i for i, f in enumerate(files)}, matrix, np.cumsum(matrix, axis=0) - matrix, matrix.sum(axis=0)))
    schema = T.StructType([*docs.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType())])

    def assign(batches):
        index, m, before, total = plan.value
        for b in batches:
            path, place = b.column(b.num_columns - 2).dictionary_encode(), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            code, to, slot = path.indices.to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k, name in enumerate(path.dictionary.to_pylist()):
                here, f = np.flatnonzero(code == k), index.get(name, -1)
                upto = np.cumsum(m[f])
                if f < 0 or place[here].max() >= upto[-1]:
                    raise RuntimeError(f"{name} has other rows than when it was counted")
                at = permute(place[here], int(upto[-1]), seed * 1_000_003 + shards + f)
                to[here] = s = np.searchsorted(upto, at, side="right")
                slot[here] = before[f, s] + at - (upto - m[f])[s]
            for s in np.unique(to):
                here = np.flatnonzero(to == s)
                slot[here] = permute(slot[here], int(total[s]), seed * 1_000_003 + int(s))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(to.astype(np.int32)), pa.array(slot)], names=schema.names)

    dealt = rows.mapInArrow(assign, schema)
    return dealt.repartitionByRange(max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
