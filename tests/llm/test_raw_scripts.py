"""Scripts end at their end tag, whatever they hold."""

from __future__ import annotations

import pytest

from scholium.llm import html_text

A, B = "<p>First paragraph with enough words to be read.</p>", "<p>Second paragraph with enough words as well.</p>"
TEXT = "First paragraph with enough words to be read.\nSecond paragraph with enough words as well."


@pytest.mark.parametrize("code", ["for(i=0;i<n;i++){f()}", "<!-- hidden from old browsers", "document.write('<a href=\"x');", "if(a<b&&c<d)f('</p>')"])
@pytest.mark.parametrize("name", ["script", "style"])
def test_text_after_a_script_stays(name, code):
    raw = f"<{name}>{code}</{name}>"
    for page in (f"<article>{A}{raw}{B}</article>", f"<body>{raw}<article>{A}{B}</article></body>", f"<article>{A}{B}</article>{raw}"):
        assert html_text.extract(page, html_text.Model()) == TEXT
