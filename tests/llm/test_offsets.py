"""A shared passage without white space, at every offset."""

import numpy as np


def test_unspaced_passages_meet_at_any_offset(spark):
    from tessera.llm import winnow as W

    rng = np.random.default_rng(3)
    letters = lambda n, low: "".join(map(chr, rng.integers(low, low + 3000, n)))
    rows = []
    for k in range(9):
        passage = letters(W.W + W.K - 1 + k, 0x4E00)
        rows += [(k, p, letters(20, 0x6000) + "x" * p + passage + letters(20, 0x7000)) for p in range(5)]
    got = W.with_fingerprint(spark.createDataFrame(rows, "k int, p int, t string"), "t", "fp").select("k", "p", W.hashes("fp").alias("h")).collect()
    by = {(r["k"], r["p"]): set(r["h"]) for r in got}
    assert all(by[k, 0] & by[k, p] for k in range(9) for p in range(5))
    units = spark.createDataFrame([("short words " + "z" * 17 + " " + "y" * 16,)], "t string").select(W._units("t").alias("u")).first()["u"]
    assert units == ["shor", "t", "word", "s", *"z" * 17, *["yyyy"] * 4]
