"""Packing into fixed-length sequences as a cutting-stock problem, solved by column generation.

1. Tokenize once into the shared folder. A document longer than the sequence length L gives full pieces of L tokens and
   one remainder; only remainders need packing. Each row keeps its rank among the rows of its own task and length.
2. The histogram of remainder lengths (at most L-1 numbers) goes to the driver. Lengths are rounded up to classes of
   `grain` tokens, which keeps the program small; the linear program over patterns of classes starts from one-class
   patterns; knapsack dynamic programming prices new columns with the dual values until no pattern can
   improve it, or the dual bound is within `gap` of the optimum. Columns that one run of the programming found beside
   the best are kept and priced before it runs again.
3. Pattern counts are rounded down, and patterns that would pad more than `waste` of a sequence are dropped. The pieces
   left over are laid end to end and cut at the sequence length, so they pad the last sequence only.
4. Documents are ranked in their class by length. A document's rank is that of its length's first, plus the counts of
   the tasks before its own, plus its rank in the task; the histogram tells which length any rank has. So patterns are
   given to ranked documents, and offsets without gaps found, by arithmetic: no sort, no window over documents, no
   exchange.

Scale: the driver sees L numbers however many rows there are. Texts are read once, ids are written once and never
shuffled. A length that a third of all documents share is only a large count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.llm.bpe import encoder
from tessera.llm.common import prepare, save, scratch, store


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Over multisets of lengths within each capacity: the best value, and the index that a best one takes next."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            v = best[c - lengths[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    return best, took


def _columns(best: np.ndarray, took: np.ndarray, values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The best pattern that holds each length, as far as it would lower the cost; the best of all comes first."""
    worth = values + best[capacity - lengths]
    found = [i for i in np.argsort(-worth, kind="stable") if worth[i] > 1 + 1e-9]
    out = np.zeros((len(found), len(lengths)), np.float32)
    for row, i in zip(out, found, strict=True):
        c = capacity - int(lengths[i])
        row[i] = 1
        while c > 0:
            if (j := took[c]) < 0:
                c -= 1
            else:
                row[j] += 1
                c -= int(lengths[j])
    return np.unique(out, axis=0) if len(out) else out


def solve_patterns(demand: np.ndarray, capacity: int, waste: float = 0.0, gap: float = 2e-3, rounds: int = 3000) -> list[tuple[int, dict[int, int]]]:
    """demand[l]: pieces of length l. Returns (count, {length: times}): full patterns, which together use no more than
    the demand."""
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return []
    d, m = demand[lengths].astype(float), len(lengths)
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / (capacity // lengths))
    x = inverse @ d
    pool = np.zeros((0, m), np.float32)
    for _ in range(rounds):
        y = inverse.sum(axis=0)  # every pattern costs one sequence
        worth = pool @ y.astype(np.float32)
        if not len(pool) or worth.max() <= 1 + 1e-4:
            best, took = knapsack(y, lengths, capacity)
            pool = _columns(best, took, y, lengths, capacity)
            if not len(pool) or x.sum() - float(y @ d) / max(best[capacity], 1) <= gap * x.sum():
                break
            worth = pool @ y.astype(np.float32)
        a = pool[int(worth.argmax())].astype(float)
        step = inverse @ a
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        out = up[np.argmin(x[up] / step[up])]
        t = x[out] / step[out]
        x -= t * step
        x[out] = t
        np.maximum(x, 0, out=x)
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.outer(step, inverse[out])
        columns[out] = a
    left, found = demand.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        pattern = {int(lengths[j]): int(columns[i][j]) for j in np.flatnonzero(columns[i])}
        if capacity - sum(l * k for l, k in pattern.items()) > waste * capacity:
            continue
        n = min([int(np.floor(x[i] + 1e-6)), *(int(left[l]) // k for l, k in pattern.items())])
        if n > 0:
            found.append((n, pattern))
            for l, k in pattern.items():
                left[l] -= n * k
    return found


class Plan:
    """Where each ranked remainder goes. `demand[l]`: remainders of length l. Its size depends on L and grain alone."""

    def __init__(self, demand: np.ndarray, length: int, grain: int):
        self.length, self.grain = length, grain
        self.capacity = length // grain
        classes = -(-np.arange(len(demand)) // grain)
        wide = np.bincount(classes, weights=demand, minlength=self.capacity + 2).astype(np.int64)
        self.lengths = {int(c): np.flatnonzero((classes == c) & (demand > 0)) for c in np.flatnonzero(wide)}
        self.first = {c: np.concatenate([[0], np.cumsum(demand[ls])]).astype(np.int64) for c, ls in self.lengths.items()}  # ranks
        self.tokens = {c: np.concatenate([[0], np.cumsum(demand[ls] * ls)]).astype(np.int64) for c, ls in self.lengths.items()}
        self.patterns: list[list[tuple[int, int, int]]] = []  # (class, times, first rank)
        entries: dict[int, list] = {}
        rank, sequence = dict.fromkeys(self.lengths, 0), 0
        fits = np.where(np.arange(len(wide)) <= self.capacity, wide, 0)
        for n, pattern in solve_patterns(fits, self.capacity):
            own = []
            for c, k in sorted(pattern.items(), reverse=True):
                entries.setdefault(c, []).append((rank[c], k, sequence, len(self.patterns), len(own)))
                own.append((c, k, rank[c]))
                rank[c] += n * k
            self.patterns.append(own)
            sequence += n
        self.entries = {c: np.array(e, dtype=np.int64) for c, e in entries.items()}
        self.left, self.run, at = rank, {}, 0
        for c in self.lengths:
            self.run[c] = at
            at += int(self.tokens[c][-1]) - self.before(c, rank[c])
        self.first_run, self.first_full = sequence, sequence - (-at // length)

    def before(self, c: int, rank: int) -> int:
        """Tokens of the class's remainders of lower rank."""
        i = int(np.searchsorted(self.first[c], rank, "right")) - 1
        over = rank - int(self.first[c][i])
        return int(self.tokens[c][i]) + (over * int(self.lengths[c][i]) if over else 0)

    def place(self, l: int, k: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the pieces of the k-th remainder of length l."""
        c = -(-l // self.grain)
        g = k + int(self.first[c][np.searchsorted(self.lengths[c], l)])
        if g < self.left[c]:
            e = self.entries[c]
            first, times, sequence, pattern, at = e[np.searchsorted(e[:, 0], g, "right") - 1].tolist()
            copy, i = divmod(g - first, times)
            offset = self.before(c, g) - self.before(c, g - i)
            for other, m, start in self.patterns[pattern][:at]:
                offset += self.before(other, start + (copy + 1) * m) - self.before(other, start + copy * m)
            return [(sequence + copy, offset, l)]
        q, offset = divmod(self.run[c] + self.before(c, g) - self.before(c, self.left[c]), self.length)
        one = min(l, self.length - offset)
        return [(self.first_run + q, offset, one)] + ([(self.first_run + q + 1, 0, l - one)] if one < l else [])


def tokenize_ranked(docs: DataFrame, vocabulary: str, end_id: int, length: int) -> DataFrame:
    """doc_id, ids (with the end id), task, rest (tokens beyond full pieces), rank (among the task's rows of that rest),
    full (the task's full pieces before this row); written to the shared folder."""
    spark = prepare(docs.sparkSession)
    add = [("ids", T.BinaryType()), ("task", T.LongType()), ("rest", T.IntegerType()), ("rank", T.LongType()), ("full", T.LongType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*x) for x in add)])
    end = np.uint32(end_id).tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        seen, full = np.zeros(length, dtype=np.int64), 0
        for b in batches:
            ids = [i + end for i in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            rest, rank, before = [], [], []
            for i in ids:
                q, r = divmod(len(i) // 4, length)
                rest.append(r)
                rank.append(int(seen[r]))
                before.append(full)
                seen[r] += 1
                full += q
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([task] * len(ids), pa.int64()), pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())], names=schema.names)

    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
    path = scratch(spark, "pack-ids")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, grain: int = 4) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).

    `start` counts the document's ids before the piece. Pieces of a sequence follow one another from offset 0 without a
    gap. Null text: empty, one end id. Null or repeated doc_id: each row is a document of its own. Empty table: empty
    result. Other columns are ignored. `length` may be any whole number from 2 on.
    """
    spark = prepare(docs.sparkSession)
    rows = tokenize_ranked(docs, vocabulary, end_id, length)
    counts = rows.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"))
    full = rows.groupBy("task").agg(F.sum(((F.octet_length("ids") / 4 - F.col("rest")) / length).cast("long")).alias("n")).select("task", F.lit(0).alias("rest"), "n")
    counts = save(counts.where("rest > 0").unionByName(full), scratch(spark, "pack-counts"))
    demand = np.zeros(length, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        if r["rest"]:
            demand[r["rest"]] = r["n"]
    before = counts.withColumn("at", F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    path = scratch(spark, "pack-before")
    before.groupBy("task").agg(F.collect_list(F.struct("rest", "at")).alias("before")).repartitionByRange("task").sortWithinPartitions("task").write.parquet(path)
    plan = spark.sparkContext.broadcast(Plan(demand, length, grain))
    fields = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*x) for x in fields)])

    def place(batches):
        at = lru_cache(16)(lambda task: _before(path, task, length))
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            doc, ids, task, rest, rank, full = (b.column(i).to_pylist() for i in range(6))
            for d, raw, t, r, k, f in zip(doc, ids, task, rest, rank, full, strict=True):
                n, base = len(raw) // 4, at(t)
                for i in range(n // length):
                    _put(out, d, i * length, length, n, plan.value.first_full + int(base[0]) + f + i, 0, raw[4 * i * length : 4 * (i + 1) * length])
                start = n - r
                for sequence, offset, size in plan.value.place(r, int(base[r]) + k) if r else []:
                    _put(out, d, start, size, n, sequence, offset, raw[4 * start : 4 * (start + size)])
                    start += size
            cols = [pa.array(out[0], b.schema.field(0).type), *(pa.array(x, pa.int64()) for x in out[1:6]), pa.array(out[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(place, schema)


def _put(out: list[list], *values) -> None:
    for column, v in zip(out, values, strict=True):
        column.append(v)


def _before(path: str, task: int, length: int) -> np.ndarray:
    """How many rows of each rest (at 0: full pieces) the tasks before this one have; read from the shared folder."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    files, where = store(path)
    got = ds.dataset(where, filesystem=files, format="parquet", exclude_invalid_files=False).to_table(filter=pc.field("task") == task)
    out = np.zeros(length, dtype=np.int64)
    for x in got["before"][0].as_py():
        out[x["rest"]] = x["at"]
    return out
