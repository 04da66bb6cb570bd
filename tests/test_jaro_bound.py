"""The bound by letters loses nothing and spares nearly all comparisons of unlike texts."""

import hashlib
import random

from scholium.functions import fuzzy


def test_bound_loses_nothing():
    rnd = random.Random(5)
    texts = ["", "a", "ab", "martha", "marhta", "dixon", "dicksonx"] + ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))) for _ in range(150)]
    for least in (0.3, 0.7, 0.85, 0.92, 1.0):
        for a in texts:
            for b in texts:
                full, got = fuzzy.jaro_winkler_of(a, b), fuzzy.jaro_winkler_from(a, b, least)
                assert got == full if full >= least else got in (0.0, full), (a, b, least)


def test_unlike_texts_are_not_compared(monkeypatch):
    asked, whole = [], fuzzy.jaro_winkler_of
    monkeypatch.setattr(fuzzy, "jaro_winkler_of", lambda a, b: asked.append(a) or whole(a, b))
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(100)]
    assert all(fuzzy.jaro_winkler_from(a, b, 0.92) < 0.92 for a in digests for b in digests if a != b)
    assert len(asked) < 100
