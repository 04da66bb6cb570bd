"""A secret is masked to its end."""

from __future__ import annotations

import pytest

from scholium.llm import pii


@pytest.mark.parametrize("length", [20, 128, 129, 300, 5000])
def test_a_long_secret_goes_whole(length):
    value = ("a1B2c3D4_x" * length)[:length]
    text = f"login token={value} end"
    (kind, start, end, code, base), *rest = pii.propose(text)[1]
    assert (pii.KINDS[kind], start, end, base, rest) == ("secret", 6, 12 + length, False, [])
    assert pii._Redactor(frozenset({code}), ["text"]).mask(text) == "login [SECRET] end"
