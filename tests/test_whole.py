"""Queries that must use every row and every token."""

from pyspark.sql import functions as F


def test_span_pool_uses_tokens_beyond_64(spark, tmp_path):
    from tessera.queries.features import QUERIES

    text = " ".join(["filler"] * 64 + ["distinctive"])
    spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["row_idx"], r["max_act"], r["freq"]) for r in QUERIES["e6_span_pool"](spark, str(tmp_path)).collect())
    assert got == [(0, 1.6, round(64 / 65, 6)), (0, 2.1, round(1 / 65, 6))]


def test_permutation_takes_parts_beyond_100(spark, monkeypatch):
    from tessera.operators import audit as A
    from tessera.queries.audits import QUERIES, _xy

    seen, d = [], "/root/testdata/sf0.001"
    keep = A.replicates
    monkeypatch.setattr(A, "replicates", lambda pairs, n, *more: seen.append(pairs.agg(F.count("*"), F.min("id"), F.max("id")).first()) or keep(pairs, 20, *more))
    assert QUERIES["g42_permutation_p"](spark, d).count() == 1
    n = _xy(spark, d).where("y IS NOT NULL").count()
    assert n > 100 and len(seen) == 3 and all(tuple(r) == (n, 0, n - 1) for r in seen)
