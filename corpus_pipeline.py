"""The corpus pipeline: toxicity, exact deduplication, near deduplication, packing.

Every stage but the last keeps the columns of documents, extra ones too, whatever their names. Null texts count as empty:
they score as a text that says nothing, are equal to each other and to empty ones, have no near copy, and pack as the end id
alone. Rows that repeat a doc_id are told apart by their place in the file. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import prepare, save, scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; trained on the labelled rows of documents outside the held-out fold."""
    from tessera.llm.toxicity import drop_toxic

    prepare(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the document with the largest doc_id; of ties the last row by place. Null doc_ids
    count as the smallest."""
    from tessera.llm.dedup import keep_one

    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the row with the smallest doc_id; of ties the first by place.
    Rows without a word or without a doc_id all stay."""
    from tessera.llm.minhash import keep_first

    return keep_first(docs, width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, as op3_packing returns them, of all documents that are left."""
    import public_tokenizers

    from tessera.llm.packing import pack

    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't train the scores or pack; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
