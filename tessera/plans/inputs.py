"""Preference-data views of the test tables. Each rule is plain SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: N rows, numbered densely from 0.
EXAMPLES = "SELECT o_orderkey AS row_idx, o_orderkey AS example_id FROM orders"
#: Sparse activations in long form: line items are responses, orders are prompts.
FEATURES = """
SELECT l_orderkey AS row_idx, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'R' END AS side, CAST(l_partkey % 256 AS INT) AS feature,
       max(l_quantity) / 50 AS max_act, max(l_discount) AS freq
FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2, 3
UNION ALL
SELECT o_orderkey, 'P', CAST(o_custkey % 64 AS INT), (1 + o_custkey % 9) / 10.0e0, (1 + o_orderkey % 7) / 10.0e0 FROM orders
UNION ALL
SELECT o_orderkey, 'P', CAST(64 + o_custkey % 5 AS INT), (1 + o_orderkey % 11) / 10.0e0, 0.5e0 FROM orders WHERE o_orderstatus <> 'P'
"""
CLUSTERS = "SELECT DISTINCT CAST(l_partkey % 256 AS INT) AS feature, CAST(l_partkey % 256 % 16 + 1 AS INT) AS m FROM lineitem"
ASSIGNMENTS = "SELECT o_orderkey AS row_idx, CAST(o_custkey % 8 + 1 AS INT) AS k FROM orders"
#: The examples that stand for a live text: those of the customer with most orders.
LIVE = "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)"
DOC_PAIRS = """
SELECT a.doc_id AS row_idx, a.text AS left_text, b.text AS right_text, a.doc_id + 0 AS example_id,
       CASE WHEN coalesce(lb.quality, 0) > coalesce(la.quality, 0) THEN b.text ELSE a.text END AS chosen,
       CASE WHEN coalesce(lb.quality, 0) > coalesce(la.quality, 0) THEN a.text ELSE b.text END AS rejected,
       q.text AS prompt
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
LEFT JOIN labels la ON la.doc_id = a.doc_id LEFT JOIN labels lb ON lb.doc_id = b.doc_id
JOIN benchmark q ON q.item_id = (a.doc_id / 2) % 40
WHERE a.doc_id % 2 = 0
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows over the parquet tables of sf_dir. The plan is bound at once, so names may be used again."""
    for t in TABLES:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            base(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EXAMPLES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FEATURES)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLUSTERS)


def live(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The rows of the examples that stand for a live text."""
    return rows.join(view(spark, sf_dir, LIVE).withColumnRenamed("o_orderkey", "row_idx"), "row_idx", "left_semi")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ASSIGNMENTS)


def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turns array<struct(turn, role, content)> in order."""
    from pyspark.sql import functions as F

    t = base(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
