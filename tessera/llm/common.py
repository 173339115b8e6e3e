"""Helpers that the operators share: scratch tables, row locators, session settings."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make this package importable in the Python workers.

    Batches are cut by rows and by bytes, so a run of very long texts can't fill a worker.
    The package goes to the executors by Spark's own file distribution.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except AnalysisException:  # not a session setting in older releases
        pass
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        p = os.path.join(folder, name)
                        z.write(p, os.path.relpath(p, os.path.dirname(top)))
        at = os.path.join(tempfile.mkdtemp(), f"tessera_{uuid.uuid4().hex[:8]}.zip")
        with open(at, "wb") as f:
            f.write(raw.getvalue())
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera_")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that still read them must be written before."""
    remove(spark, *_made.pop(spark.sparkContext.applicationId, []))


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The scratch tables of one call, by name, so that those no longer read can be deleted."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch(self.spark, f"{self.label}-{name}")
        return save(df, self.paths[name])

    def remove(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(n) for n in names))


#: A row's place in its file: names each row for good, even where doc_id is null or repeated.
FILE, ROW = "_tessera_file", "_tessera_row"


def _one_row_each(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of a file, at most once: a scan with filters and projections that always agree."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def located(docs: DataFrame, label: str, *columns: Column | str, names: tuple[str, str] = (FILE, ROW)) -> DataFrame:
    """The columns asked for (all by default) with the row's file and its place in it, under `names`.

    A frame of which a file's row could give several rows, or that isn't read from files, is written to the shared folder
    first. Columns of docs that are named as the metadata column are left alone.
    """
    columns = columns or ("*",)

    def placed(df):
        meta = df.metadataColumn("_metadata")
        return df.select(*columns, meta.getField("file_path").alias(names[0]), meta.getField("row_index").alias(names[1]))

    if _one_row_each(docs):
        try:
            return placed(docs)
        except AnalysisException:  # no row numbers in files of this kind, or the column was projected away
            pass
    return placed(save(docs, scratch(docs.sparkSession, label)))


def without(docs: DataFrame, label: str, gone) -> DataFrame:
    """docs less the rows that `gone` returns, as it is: `gone` takes doc_id, text, FILE and ROW and returns some rows with
    FILE and ROW."""
    names = tuple(f"{n}_{uuid.uuid4().hex[:12]}" for n in (FILE, ROW))
    rows = located(docs, label, names=names)
    own = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col(names[0]).alias(FILE), F.col(names[1]).alias(ROW))
    return rows.join(gone(own).select(F.col(FILE).alias(names[0]), F.col(ROW).alias(names[1])), list(names), "left_anti").drop(*names)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty. Pure ASCII texts take the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def store(uri: str):
    """pyarrow's file system and path for a Spark path, for the workers' own reads and writes in the shared folder."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
