"""The registered queries against their SQL, and the pipeline against a brute-force version of its stages."""

import collections

import pytest

from tests.oracle import same

D = "/root/testdata/sf0.001"


def test_queries_have_the_contract_columns(spark):
    from tessera.llm import queries as Q

    assert sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0])) == ["op1_toxicity", "op2_near_dedup", "op3_packing", "op4_byte_bpe", "op5_exact_dedup", "op6_token_files", "op7_sharding", "op8_fingerprints", "op9_licenses", "op10_chat_format"]


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op10_chat_format"])
def test_against_sql(spark, name):
    from tessera.llm import queries as Q

    same(spark, D, Q.queries()[name], Q.oracle_sql()[name])


def test_fingerprint_query(spark):
    import hashlib

    from tessera.llm import queries as Q

    docs = sorted(map(tuple, spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()))
    rows = {r["doc_id"]: r for r in Q.queries()["op8_fingerprints"](spark, D).collect()}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    from tessera.llm.common import save, scratch
    from tessera.llm.toxicity import fit

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    model = fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    want = {i: t for i, t in texts.items() if model.score(t) < 0.5}
    out = save(P.STAGES[0][1](spark, docs, D), scratch(spark, "t"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(want)
    last = {}
    for i in sorted(want):
        last[want[i].encode().lower()] = i
    want = {i: want[i] for i in last.values()}
    out = save(P.STAGES[1][1](spark, out, D), scratch(spark, "t"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(want)
    sets = {}
    for i, t in want.items():
        w = t.encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in want if find(i) == i}
    out = save(P.STAGES[2][1](spark, out, D), scratch(spark, "t"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    pieces = collections.Counter()
    for r in P.STAGES[3][1](spark, out, D).collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {i for i, _ in pieces} == want and all(n == total for (_, n), total in pieces.items())
