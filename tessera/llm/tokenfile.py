"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a run of frames, one for each document (its ids as little-endian uint32), then a skippable frame with the
documents' ids and the XXH64 of all before it in that frame and of the seek table's entries, then the seek table in the
published seekable format: a skippable frame with, for each frame, its compressed size, its size and the low 32 bits of the
XXH64 of its content. So no changed byte gives a wrong document or id: a document's own checksum, that of the ids
and entries, or parts that no longer meet tell of it (bits of a frame's head that mean nothing may change unnoticed). Any zstandard tool can read the file whole; a
reader here takes the table from the end, then only the frames that it wants.

Scale: one range exchange of the texts by doc_id; a task writes files of bounded size and holds one frame. A file gets
its final name only through the manifest that Spark commits, so a lost or repeated task leaves at most an unused file.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.llm.bpe import encoder
from tessera.llm.common import prepare, save, scratch, store

SKIPPABLE, DOC_IDS, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1  # fixed values of the zstandard formats
EMPTY = 0x51D8E999  # the low 32 bits of the XXH64 of no bytes
MAX_FRAMES = 1 << 16


class FrameWriter:
    """Writes frames to a binary stream; close() adds the document ids and the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        import xxhash

        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.size += len(frame)

    def close(self) -> None:
        import xxhash

        ids = struct.pack("<I", len(self.ids)) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.packbits([x is not None for x in self.ids]).tobytes()
        self.entries.append((len(ids) + 16, 0, EMPTY))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.out.write(struct.pack("<II", DOC_IDS, len(ids) + 8) + ids + struct.pack("<Q", xxhash.xxh64_intdigest(ids + table)))
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE))


class FrameReader:
    """Reads single documents of a file: reader[i] is the i-th one's ids as bytes. `source` can seek and read."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        source.seek(max(end - 9, 0))
        tail = source.read(9)
        n, flags, magic = struct.unpack("<IBI", tail) if len(tail) == 9 else (0, 0, 0)
        at = end - 17 - 12 * n
        if magic != SEEKABLE or flags != 0x80 or not n or at < 0:
            raise ValueError("no seek table with checksums at the end")
        source.seek(at)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        raw = source.read(12 * n)
        table = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        self.starts, self.table = np.cumsum(table[:, 0]) - table[:, 0], table[:-1]
        if self.starts[-1] + table[-1, 0] != at or table[-1, 0] < 20:
            raise ValueError("the frames don't reach to the seek table")
        source.seek(int(self.starts[-1]))
        ids = source.read(int(table[-1, 0]))
        head, ids, check = struct.unpack("<II", ids[:8]), ids[8:-8], struct.unpack("<Q", ids[-8:])[0]
        if head != (DOC_IDS, len(ids) + 8) or xxhash.xxh64_intdigest(ids + raw) != check or struct.unpack("<I", ids[:4])[0] != n - 1:
            raise ValueError("the document ids or the seek table are damaged")
        count = n - 1
        known = np.unpackbits(np.frombuffer(ids[4 + 8 * count :], np.uint8), count=count)
        self.ids = [int(x) if k else None for x, k in zip(np.frombuffer(ids[4 : 4 + 8 * count], "<i8"), known, strict=True)]

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> bytes:
        import xxhash

        packed, size, check = self.table[i].tolist()
        self.source.seek(int(self.starts[i]))
        raw = self.zip.decompress(self.source.read(packed), max_output_size=size) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Encode docs in ascending doc_id order into files below `folder`; returns the manifest.

    Manifest: task, part, file, documents, tokens, first_token (ids of all documents before the file). Null doc_id: first.
    Null text: empty, one end id. Repeated doc_id: one after another. Empty table: no file. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or scratch(spark, "token-files")
    end = np.uint32(end_id).tobytes()
    fields = [("task", T.LongType()), ("part", T.LongType()), ("file", T.StringType()), ("documents", T.LongType()), ("tokens", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in fields])

    def run(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        files, where = store(folder)
        files.create_dir(where, recursive=True)
        open_file, name, part, tokens = None, "", 0, 0

        def row(w):
            w.close()
            w.out.close()
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([part], pa.int64()), pa.array([name]), pa.array([len(w.ids)], pa.int64()), pa.array([tokens], pa.int64())], names=schema.names)

        for b in batches:
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            for d, raw in zip(b.column(0).to_pylist(), ids, strict=True):
                if open_file is None:
                    name, tokens = f"ids-{task:06d}-{part:04d}-{uuid.uuid4().hex[:12]}.zst", 0
                    open_file = FrameWriter(files.open_output_stream(f"{where}/{name}", compression=None))
                raw += end
                open_file.add(d, raw)
                tokens += len(raw) // 4
                if open_file.size >= file_bytes or len(open_file.ids) >= MAX_FRAMES:
                    yield row(open_file)
                    open_file, part = None, part + 1
        if open_file is not None:
            yield row(open_file)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = save(text.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema), scratch(spark, "token-manifest"))
    tasks = made.groupBy("task").agg(F.sum("tokens").alias("n"))  # one row a task: the window below is over tasks, not documents
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return save(made.withColumn("inside", inside).join(before, "task").select("task", "part", F.concat(F.lit(folder + "/"), "file").alias("file"), "documents", "tokens", (F.col("before") + F.col("inside")).alias("first_token")), scratch(spark, "token-index"))


def read_token_files(manifest: DataFrame, wanted=None) -> DataFrame:
    """doc_id, start, ids (binary) of every document of the manifest's files, frame checksums verified.

    `wanted`: a function of a doc_id; frames of other documents are not decompressed.
    """
    spark = prepare(manifest.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first_token").to_pylist(), strict=True):
                files, where = store(name)
                with files.open_input_file(where) as source:
                    reader, doc, start, ids, held = FrameReader(source), [], [], [], 0
                    at = first
                    for i, d in enumerate(reader.ids):
                        if wanted is None or wanted(d):
                            doc.append(d)
                            start.append(at)
                            ids.append(reader[i])
                            held += len(ids[-1])
                        at += int(reader.table[i, 1]) // 4
                        if held > 8 << 20 or i == len(reader) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
                            doc, start, ids, held = [], [], [], 0

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "first_token").repartition(n, "file").mapInArrow(run, schema)
