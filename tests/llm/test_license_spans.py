"""License matches against exact containment of every span."""

import numpy as np

from tessera.llm import license as L


def exact(lib, text):
    """name -> the best containment over all spans of up to twice the template's words."""
    words, best = L.WORD.findall(text.lower()), {}
    for (size, width), g in lib.groups.items():
        some = L._shingles(words, width)
        for name, own in g["sets"].items():
            for a in range(len(some)):
                if some[a] in own:
                    best[name] = max(best.get(name, 0), len(own.intersection(some[a : a + 2 * size - width + 1])) / len(own))
    return best


def test_insertions_and_edits_against_every_span():
    lib, rng = L.Library(L.TEMPLATES, 0.8), np.random.default_rng(5)
    noise = [f"n{i}" for i in range(300)] + ["the", "software", "license", "copyright"]
    want = hit = low = caught = 0
    for trial in range(600):
        name = sorted(L.TEMPLATES)[trial % len(L.TEMPLATES)]
        words = L.WORD.findall(L.TEMPLATES[name])
        if trial % 2:
            at = int(rng.integers(1, max(2, len(words))))
            words[at:at] = list(rng.choice(noise, int(rng.integers(1, max(2, len(words) // 2)))))
        for i in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 20))):
            words[i] = "zzz"
        text = " ".join([*rng.choice(noise, int(rng.integers(0, 60))), *words, *rng.choice(noise, int(rng.integers(0, 60)))])
        true = {n: s for n, s in exact(lib, text).items() if s >= 0.8}
        got = {}
        for n, a, z, share in lib.scan(text):
            got[n] = max(got.get(n, 0), share)
            assert 0 <= a < z <= len(text)
        assert all(n in true and abs(s - true[n]) < 1e-12 for n, s in got.items())
        want, hit = want + len(true), hit + len(got)
        low += sum(s < 0.9 for s in true.values())
        caught += sum(s < 0.9 and n in got for n, s in true.items())
    assert want > 200 and low > 20 and hit / want >= 0.98 and caught / low >= 0.9


def test_words_put_into_the_middle():
    lib = L.Library(L.TEMPLATES, 0.8)
    for name, text in L.TEMPLATES.items():
        words = text.split()
        if len(words) >= 60:
            for extra in (17, 25):
                got = lib.scan(" ".join([*words[: len(words) // 2], *(f"x{i}" for i in range(extra)), *words[len(words) // 2 :]]))
                assert [m[0] for m in got if m[0] == name] == [name] and got[0][3] >= 0.9


def test_copies_side_by_side_are_matches_of_their_own():
    lib = L.Library(L.TEMPLATES, 0.8)
    for name, text in L.TEMPLATES.items():
        got = [m for m in lib.scan(" ".join([text] * 4)) if m[0] == name]
        assert len(got) == 4 and all(m[3] == 1.0 for m in got)
    long = "some filler words " * 20_000 + L.TEMPLATES["mit-permission"]
    assert [m[0] for m in lib.scan(long) if m[3] == 1.0] and lib.scan("") == [] and lib.scan(None) == []
