"""Near copies of very few shingles whose sketches share no band."""

import numpy as np


def test_small_sets_that_share_no_band_are_linked(spark):
    from tessera.llm import minhash as M

    rng = np.random.default_rng(5)
    pairs = []
    while len(pairs) < 3:
        some = [[f"w{x}" for x in rng.integers(0, 10**6, 6)] for _ in range(2000)]
        regs = [np.stack([M.sketch(M.shingle_set(" ".join(w[:n]), 2)) for w in some]) for n in (5, 6)]
        a, b = (M.band_keys(r) for r in regs)
        pairs += [some[i] for i in np.flatnonzero(~(a == b).any(axis=1))]
    rows = [(2 * i + k, " ".join(w[: 5 + k])) for i, w in enumerate(pairs) for k in (0, 1)]
    got = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_exact_keys_leave_no_pair_out():
    from tessera.llm import minhash as M

    rng = np.random.default_rng(6)
    for _ in range(3000):
        n = int(rng.integers(1, 22))
        a = np.unique(M.mix(rng.integers(0, 1 << 62, n, np.uint64)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], M.mix(rng.integers(0, 1 << 62, int(rng.integers(0, 3)), np.uint64))]))
        near = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and not np.array_equal(a, b)
        if near and min(len(a), len(b)) <= M.SMALL:
            assert len(np.intersect1d(M.exact_keys(a, 80), M.exact_keys(b, 80)))
