"""Toxic content far inside one long run of letters."""

import numpy as np


def test_long_runs_count_whole():
    from tessera.llm.toxicity import LONGEST, train, words

    run = "".join(chr(97 + i * 7 % 26) for i in range(1001))
    for n in (1, 63, 64, 65, 96, 97, 128, 129, 1001):
        got = words(run[:n])
        assert all(len(w) <= LONGEST for w in got) and got[0] == run[: min(n, LONGEST)] and got[-1] == run[:n][-len(got[-1]) :]
        assert {run[i : i + 5] for i in range(n - 4)} <= {w[i : i + 5] for w in got for i in range(len(w) - 4)}
    rng = np.random.default_rng(1)
    clean = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(3, 9))))) for _ in range(300)]
    some = lambda k: [clean[int(i)] for i in rng.integers(0, 300, k)]
    texts, labels = [], []
    for i in range(200):
        texts.append(" ".join(some(8) + ["horrid", "vile", "wretched"] * (i % 2) + some(8)))
        labels.append(i % 2)
    model = train(texts, labels)
    front = "".join(some(40))
    assert len(front) > 128
    assert model.score(front + "horridvilewretched" * 4) > model.score(front) + 0.1
