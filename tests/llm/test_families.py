"""Near-duplicates: families whose members differ from the hub more than from each other."""

import random
from itertools import combinations

import pytest

from tessera.llm import minhash as M

pytestmark = pytest.mark.filterwarnings("ignore")


def edited(words, places, rng):
    out = list(words)
    for i in places:
        out[i] = f"w{rng.randrange(10**9)}"
    return out


def smallest(texts, percent=80):
    """The component of each text by all pairs of sets of two-word shingles."""
    sets = [set(zip(t, t[1:], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(texts))]


def test_a_family_beside_the_hub_is_joined_by_few_pairs(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    near = [edited(base, rng.sample(range(120), 2), rng) for _ in range(150)]
    moved = edited(base, range(40, 60), rng)  # 21 of 119 shingles: not linked with the others, but like them
    beside = [edited(moved, rng.sample(range(120), 1), rng) for _ in range(70)]
    apart = [edited(base, rng.sample(range(120), 11), rng) for _ in range(60)]
    texts = [base, *near, *beside, *apart]
    rng.shuffle(texts)
    pairs, save = {}, M.Tables.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "across":
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(M.Tables, "save", counted)
    rows = M.near_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(smallest(texts)))
    assert pairs["across"] <= len(texts)
