"""Personal data, licences, tokens, quality rules and pages: edge cases, brute force, exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import SF

from scholium.llm import bpe, html_text, licenses, pii, quality, registry, tokens

SCHEMA = "doc_id long, text string, found int, spans string, words string, row string, digest string"


def frame(spark, texts):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


TEXTS = [None, "", "  \n ", "a", "mail a@b.co or a@b.co!", "é" * 70000 + " 1.2.3.4", "same text here", "same text here", "x " * 3000]


def test_registered_queries():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES}
    assert numbers == set(range(1, 14))


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def passes(number):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(number[::-1])) % 10 == 0


def base(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and passes(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans_of_random_texts():
    rnd = random.Random(5)
    for _ in range(20000):
        text = "".join(rnd.choice("a@.@%-+1234567890 ().4é\n") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == base(text), text


def test_pii_on_the_table(spark, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = pii.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base(docs[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(v) for v in want.values()]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_pii_edges(spark):
    got = {r["doc_id"]: r for r in pii.detect(frame(spark, TEXTS)).collect()}
    assert got[4]["n_email"] == 2 and got[5]["n_ip"] == 1 and got[0]["found"] == [] and len(got) == len(TEXTS)
    assert pii.detect(frame(spark, TEXTS).limit(0)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, TEXTS)).collect()}
    assert masked[4] == "mail [EMAIL] or [EMAIL]!" and masked[0] is None and masked[5].endswith(" [IP]")


def test_em_finds_the_reliable_labeler():
    import numpy as np

    good = pii.pattern_code("phone", [2, 2, 2, 2])
    bad = pii.pattern_code("phone", [0, 0, 0, 1])
    posterior = pii.estimate(np.array([good, bad]), np.array([50.0, 50.0]))
    assert posterior[0] > 0.9 and posterior[1] < 0.1
    assert good in pii.accepted(pii.train(np.array([good, bad]), np.array([50.0, 50.0])))


def test_numbers_read_into_each_other_are_proposed_apart():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    base_found, found = pii.propose(text)
    assert not any(base_found.values())
    spans = {(pii.KINDS[k], text[s:e]) for k, s, e, code, _ in found if pii.decode_pattern(code)[1][0] != pii.NO}
    assert ("phone", "+1 (269) 555-3296") in spans
    assert (("card", "4524132264652876") in spans) == pii.luhn("4524132264652876")


def test_a_failed_check_digit_is_never_accepted():
    import numpy as np

    code = pii.pattern_code("card", [0, 2, 2, 2])
    assert code not in pii.accepted(pii.train(np.array([code]), np.array([1000.0])))


# licences


def plain_scan(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(found), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark, duck):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = licenses.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(docs[r["doc_id"]])


def test_licence_edges(spark):
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [*TEXTS, "MIT License and the MIT-LICENSE; CC-BY 4.0", "licensed under the Apache License, Version 2.0", long, "the license of mit"]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    n = len(TEXTS)
    assert (got[n]["n_base"], got[n]["first_word"], got[n]["last_word"], got[n]["base_labels"]) == (3, 0, 6, "cc-by,mit")
    assert got[n + 1]["labels"] == "apache,apache-2.0" and got[n + 2]["labels"] == "mit" and got[n + 2]["n_base"] == 0
    assert got[n + 3]["labels"] == "" and got[0]["score"] == 0.0 and got[0]["n_words"] == 0
    for i, t in enumerate(texts):
        assert got[i]["base_labels"] == plain_scan(t)[4] and got[i]["n_words"] == plain_scan(t)[0]
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def odd_texts():
    rnd = random.Random(1)
    letters = "ab  \n\t'sréñ²½一二　 \x1c\x85_!$Ⅷªº😀́e"
    out = ["", "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoftext|>", "aaaaaaaaaaaaa aaaa", "\n\n a  b\t\tc   ", "we'll I've"]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]


def test_bpe_equals_the_library(library):
    encoder = bpe.Bpe(bpe.default_path(), cache_limit=500)
    texts = odd_texts()
    for text, (joined, n, raw), want in zip(texts, encoder.round_trip(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert joined == ",".join(map(str, want.ids)) and n == len(want.ids), text
        assert raw.decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_rounds_on_words_of_one_symbol():
    encoder = bpe.Bpe(bpe.default_path())
    ids, counts = encoder.encode_words([b"a", b"", b"aaaa"])
    assert counts[1] == 0 and counts[0] == 1 and counts.sum() == len(ids)
    assert encoder.decode(encoder.encode("Öl <|endoftext|> x")) == "Öl <|endoftext|> x"


def test_bpe_and_counts_on_the_table(spark, duck, library):
    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in bpe.query(spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    for r in tokens.query(spark, SF).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)


def test_token_cache_encodes_only_misses(spark, tmp_path, library):
    cache = str(tmp_path / "cache")
    docs = frame(spark, TEXTS)
    first = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, cache).collect()}
    assert tokens._stored(spark, cache).count() == len({t or "" for t in TEXTS})
    more = frame(spark, [*TEXTS, "new one"])
    again = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(more, cache).collect()}
    assert tokens._stored(spark, cache).count() == len({t or "" for t in TEXTS}) + 1
    assert {k: again[k] for k in first} == first
    assert all(n == len(library.encode(TEXTS[i] or "", add_special_tokens=False).ids) for i, n in first.items())
    assert tokens.token_counts(docs.limit(0), cache).count() == 0


def test_fast_counts_equal_the_library(library):
    texts = odd_texts()
    assert tokens.counter(bpe.default_path())(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_edges(spark):
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, TEXTS), keep_ids=True).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["decoded"] == "" and got[5]["decoded"] == TEXTS[5] and got[4]["ids"]
    assert bpe.encode_decode(frame(spark, TEXTS).limit(0)).count() == 0


# quality rules


def test_quality_equals_its_sql(spark, duck):
    relation = duck.sql(quality.ORACLE)
    got = quality.query(spark, SF)
    columns = sorted(relation.columns)
    assert sorted(got.columns) == columns
    want = sorted(tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_quality_edges(spark):
    good = " ".join(f"word{i} the" for i in range(30))
    texts = [*TEXTS, good, "a b c d e f g h i j k l m", good.replace("word1 ", "#### "), ("x y z a b c " * 5).strip(), "&&& " * 12 + good]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    n = len(TEXTS)
    assert not got[0]["kept"] and got[0]["base_failed"] and got[0]["n_words"] == 0 and got[8]["n_repeat_words"] == 3000
    assert got[n]["kept"] and got[n]["n_repeat_words"] == 0 and got[n + 3]["n_repeat_words"] == 30 and not got[n + 4]["kept"]
    kept = quality.keep_good(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.keep_good(frame(spark, texts).limit(0)).count() == 0


def test_quality_plan_has_no_python_and_no_shuffle(spark):
    text = quality.query(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", text)


# pages

PAGE = """<html><head><title>T</title><script>if (a < b) { x("</p>") }</script></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><article><h1>Real  title</h1><p>First &amp; long paragraph with plenty of words to be read by people.<p>Second para <b>bold</b>,
<a href=q>link</a> &lt;ok&gt;&nbsp;x.</p><div class="ad">BUY NOW</div><ul><li>One item in the list<li>Two item</ul><form><input name=a><label>Your mail</label></form><aside>Beside</aside>
<section id="comments"><article class="comment"><p>Nice article, I liked it very much indeed and so on.</p></article></section></article>
<div class="sidebar"><p>Other stories you may like to read because they are long and fine.</p></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "Real title\nFirst & long paragraph with plenty of words to be read by people.\nSecond para bold, link <ok> x.\nOne item in the list\nTwo item"


def test_main_text_of_a_page():
    model = html_text.Model()
    assert html_text.extract(PAGE, model) == TEXT
    assert html_text.extract(PAGE.replace("<article><h1>", '<div class="post-content"><h1>'), model) == TEXT


def test_marked_inline_elements_do_not_break_a_block():
    page = '<article><p>Last <span class="ad">ADV</span> para of the whole text.</p><p>Next one of it.</p></article>'
    assert html_text.extract(page, html_text.Model()) == "Last para of the whole text.\nNext one of it."


def reference_text(page):
    import html

    body = page[page.find("<article>") + 9 :]
    body = body[: body.find("</article>")] if "</article>" in body else body
    body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x00", body)))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in body.split("\x00")) if x)


def test_pages_of_the_table(spark, duck):
    pages = dict(duck.sql("select page_id, html from pages").fetchall())
    got = html_text.query(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == reference_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_page_edges(spark):
    broken = ["", None, "<p", "plain", "<article><p>a<p>b", "<article>" + "<div>" * 3000 + "deep text of the page" + "</div>" * 10, "<a b='c>d", "&amp", "<script>x", "</p></b>"]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(broken)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[0] == got[1] == got[2] == "" and got[4] == "a\nb" and len(got) == len(broken)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_messages_agree_with_enumeration():
    """Marginals by messages equal those by summing over all labellings of a small tree."""
    import itertools
    import math

    model = html_text.Model()
    nodes = html_text.parse("<div><p>some words to read here</p><nav><p>Home</p></nav></div><p>and more words</p>")
    seen = html_text.evidence(nodes)
    odds = [sum(model.odds.get(f"{k}={v}", 0.0) for k, v in s.items()) for s in seen]
    unary = [(1 - 1 / (1 + math.exp(-o)), 1 / (1 + math.exp(-o))) for o in odds]
    total, yes = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes) - 1):
        labels = (0, *labels)
        p = 1.0
        for i in range(1, len(nodes)):
            on = model.child[nodes[i].kind, labels[nodes[i].parent]]
            p *= unary[i][labels[i]] * (on if labels[i] else 1 - on)
        total += p
        for i, y in enumerate(labels):
            yes[i] += p * y
    for got, want in zip(model.marginals(nodes)[1:], yes[1:]):
        assert got == pytest.approx(want / total)
