"""The pipeline's stages on nulls, empty, very long and repeated rows, clashing names and an empty table."""

D = "/root/testdata/sf0.001"


def test_stages_on_hard_rows(spark, hard, empty):
    import corpus_pipeline as P
    from tests.llm.conftest import HARD

    left = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, hard, D)
        assert out.columns == hard.columns
        left[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert all(r in HARD for r in left[name])
        assert stage(spark, empty, D).count() == 0
    assert [i for i, t in left["exact_dedup"] if not t] == [3] and sum(i == 9 for i, _ in left["exact_dedup"]) == 1
    ids = [i for i, _ in left["near_dedup"]]
    assert ids.count(9) == 1 and {2, 3, 4} <= set(ids) and ids.count(None) == 2 and 1 not in ids and 8 not in ids
    pieces = P.STAGES[-1][1](spark, hard, D).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in HARD} and all(0 < r["length"] <= 1024 for r in pieces)
    assert P.STAGES[-1][1](spark, empty, D).count() == 0
