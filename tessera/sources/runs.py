"""Folders of runs: the state that their tables come from, which of them to go on with, manifests, tables read anew on change.

Files go through Hadoop's file systems, so folders may lie on any storage that Spark reads.
"""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.storage import exists, fingerprint

log = logging.getLogger(__name__)
MANIFEST, STATE = "manifest.json", "matrices_state.json"
COMPLETE = 1_000_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a file; None where there is no file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written under another name first, so readers see the old file or the new one."""
    fs, p = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(json.dumps(value, indent=2).encode()))
    finally:
        stream.close()
    if not fs.rename(part, p):  # some file systems don't rename onto a file
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"could not put {path} in place")


def state(ids: DataFrame, d: int, column: str = "example_id") -> dict:
    """{N, d_sae, ex_hash}: rows, width of the encoder and a digest of the ids. Tables made from other ids aren't reused."""
    r = fingerprint(ids, column, d).first()
    return {"N": r["n"], "d_sae": d, "ex_hash": r["ex_hash"]}


def write_state(spark: SparkSession, folder: str, now: dict) -> None:
    """Into the manifest, where there is one that can be read, and into the state file."""
    try:
        whole = read_json(spark, f"{folder}/{MANIFEST}")
        if whole is not None:
            write_json(spark, f"{folder}/{MANIFEST}", whole | {"extraction_state": now})
    except ValueError as e:
        log.warning("the manifest of %s can't be read: %s", folder, e)
    write_json(spark, f"{folder}/{STATE}", now)


def state_valid(spark: SparkSession, folder: str, now: dict) -> bool:
    """Whether the folder's tables come from this state: by the manifest, else by the state file. Another state makes them
    invalid; files that can't be read count as missing. A folder without any state takes this one, with a warning."""
    for name, pick in ((MANIFEST, lambda v: v.get("extraction_state")), (STATE, lambda v: v)):
        try:
            value = read_json(spark, f"{folder}/{name}")
            found = pick(value) if value is not None else None
        except (ValueError, AttributeError) as e:
            log.warning("%s of %s can't be read: %s", name, folder, e)
            continue
        if found is not None:
            return found == now
    log.warning("%s has no state; taken as matching", folder)
    write_state(spark, folder, now)
    return True


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, in order."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).select("row_idx").distinct().count()


def progress(spark: SparkSession, folder: str) -> int:
    """How far a run's folder got: with the whole feature table its rows and 1,000,000; with a table that broke off 0; with
    chunks the rows of the finished ones; with examples alone 1. Row counts come from the state file where there is one."""
    have = set(folders(spark, folder))
    if "features" in have:
        if not exists(spark, f"{folder}/features"):
            return 0
        try:
            known = read_json(spark, f"{folder}/{STATE}") or {}
            return COMPLETE + int(known["N"] if "N" in known else _rows(spark, f"{folder}/features"))
        except (ValueError, TypeError, Py4JJavaError) as e:
            log.warning("rows of %s are unknown: %s", folder, e)
            return COMPLETE
    if "chunks" in have:
        done = [f"{folder}/chunks/{c}" for c in folders(spark, f"{folder}/chunks") if c.startswith("chunk_") and exists(spark, f"{folder}/chunks/{c}")]
        return sum(_rows(spark, c) for c in done)
    return int("examples" in have)


def resolve(spark: SparkSession, root: str, name: str, seed: int, use: bool = True, stamp: str | None = None) -> str:
    """The run folder that got farthest, the last by name of equals; a new name with the seed and the time where there is
    none or `use` is off."""
    if use:
        own = [d for d in reversed(folders(spark, root)) if d.startswith(f"{name}_")]
        if own:
            return f"{root}/{max(own, key=lambda d: progress(spark, f'{root}/{d}'))}"
    fs, p = _fs(spark, f"{root}/{name}_seed{seed}_{stamp or datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}")
    fs.mkdirs(p)
    return f"{root}/{p.getName()}"


def write_manifest(spark: SparkSession, folder: str, config: dict, metrics: dict, lists: dict[str, DataFrame], n: int = 10, now: dict | None = None) -> dict:
    """The run's configuration, its numbers and the first n rows of each ranked list; returns what was written."""
    top = {k: [json.loads(r["row"]) for r in df.limit(n).select(F.to_json(F.struct("*")).alias("row")).collect()] for k, df in lists.items()}  # n rows a list
    value = {"config": config, "metrics": metrics, "top": top} | ({"extraction_state": now} if now else {})
    write_json(spark, f"{folder}/{MANIFEST}", value)
    return value


def compact(spark: SparkSession, chunks: list[str], out: str, partitions: int) -> DataFrame:
    """One table from finished chunk tables, which are deleted once it is committed."""
    spark.read.parquet(*chunks).coalesce(partitions).write.mode("overwrite").parquet(out)
    for c in chunks:
        fs, p = _fs(spark, c)
        fs.delete(p, True)
    return spark.read.parquet(out)


class Reread:
    """Tables and JSON files that are read again only when their time of change differs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, {}

    def _fresh(self, path: str, read):
        fs, p = _fs(self.spark, path)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        at = next((fs.getFileStatus(x).getModificationTime() for x in (mark, p) if fs.exists(x)), None)
        if at is None:
            self.seen.pop(path, None)
            return None
        if path not in self.seen or self.seen[path][0] != at:
            self.seen[path] = (at, read())
        return self.seen[path][1]

    def json(self, path: str) -> dict | None:
        return self._fresh(path, lambda: read_json(self.spark, path))

    def table(self, path: str) -> DataFrame | None:
        def read():
            self.spark.catalog.refreshByPath(path)
            return self.spark.read.parquet(path)

        return self._fresh(path, read)
