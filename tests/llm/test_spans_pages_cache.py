"""Proposals against a quadratic version, held-out pages without marks, and the token cache over several runs."""

from __future__ import annotations

import random
import re
from collections import Counter

from conftest import SF

from scholium.llm import html_text, pii, tokens

SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]+)+")


def plain_proposals(text):
    """Each further proposal against every span taken before."""
    base = pii.base_spans(text)
    taken = [span for spans in base.values() for span in spans]
    out = []

    def more(kind, spans):
        for s, e in spans:
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out.append((kind, s, e))

    for s, e, ok in pii._matches(text)["card"]:
        if not ok:
            more("card", [m.span() for m in pii._ONE_CARD.finditer(text, s, e) if pii.luhn(m[0])])
    more("email", [m.span() for m in SPELLED.finditer(text)])
    more("phone", [m.span() for m in pii._LOCAL_PHONE.finditer(text)])
    more("secret", [m.span() for m in pii._SECRET.finditer(text)])
    return sorted(out)


def test_proposals_equal_the_quadratic_version():
    rnd = random.Random(3)
    parts = [
        "a.b (at) c (dot) org", "x[at]y.com", "(555) 123-4567", "555.123-4567", "token=abcdef12", "4111111111111111", "12 4111111111111111 9",
        "a@b.cd", "+1 555-123-4567", "1.2.3.4", "password = q1w2e3r4", " ", "word", "(at)", "at]", "=", "-", "7",
    ]
    found = 0
    for _ in range(4000):
        text = rnd.choice(["", " "]).join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
        failed = Counter((k, s, e) for k, v in pii._matches(text).items() for s, e, ok in v if not ok)
        got = sorted((Counter((pii.KINDS[k], s, e) for k, s, e, _, base in pii.propose(text)[1] if not base) - failed).elements())
        assert got == plain_proposals(text), text
        found += len(got)
    assert found > 2000


def test_long_spelled_addresses_and_many_numbers():
    long = "n" * 300
    text = f"write to {long} (at) {'d' * 200} (dot) org now"
    spans = [(s, e) for k, s, e, _, _ in pii.propose(text)[1] if pii.KINDS[k] == "email"]
    assert spans == [(9, len(text) - 4)]
    many = " ".join(f"(555) {i % 900 + 100}-{i % 9000 + 1000}" for i in range(20_000))
    assert len(pii.propose(many)[1]) == 20_000  # quadratic search would take minutes
    assert pii.propose("a" * 200_000 + " (at) ")[1] == []


def test_held_out_pages_without_marks(duck):
    pages = [h for (h,) in duck.sql("select html from pages order by page_id").fetchall() if h and re.search(r"(?i)<(article|main)[\s>]", h)]
    seen, edges = Counter(), Counter()
    for page in pages[::2]:
        nodes = html_text.parse(page)
        own = html_text.labels(nodes)
        for node, what, label in zip(nodes[1:], html_text.evidence(nodes)[1:], own[1:]):
            if label is None or own[node.parent] is None:
                continue
            seen.update((f"{k}={v}", label) for k, v in what.items() if k != "section")
            edges[node.kind, own[node.parent], label] += 1
    model = html_text.Model(seen, edges)
    both = kept = want = 0
    for page in pages[1::2]:
        truth = Counter(html_text.extract(page, model).split("\n"))
        plain = re.sub(r"(?i)(</?)(article|main)(?=[\s>])", r"\1div", page)
        assert not any(n.section == "article" for n in html_text.parse(plain))
        got = Counter(html_text.extract(plain, model).split("\n"))
        both, kept, want = both + sum((truth & got).values()), kept + sum(got.values()), want + sum(truth.values())
    assert want > 200 and both / kept >= 0.98 and both / want >= 0.98


def test_references_are_decoded_where_they_stand():
    page = "<article><p>A page of text &am<b>p; more</b> &amp;lt; and the rest of a sentence, long enough to stay.</p></article>"
    assert html_text.extract(page, html_text.Model()) == "A page of text &amp; more &lt; and the rest of a sentence, long enough to stay."


def test_token_cache_over_several_runs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None), (4, "one two")], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, tokens.token_counts(docs, cache).collect()))
    stored = tokens._stored(spark, cache)
    rows = stored.collect()
    assert len(rows) == 3
    assert sorted(map(tuple, tokens.token_counts(docs, cache).collect())) == first
    assert tokens._stored(spark, cache).count() == 3  # nothing was encoded
    # another writer stored the same digests, and counts of another tokenizer stand beside them
    spark.createDataFrame(rows, stored.schema).write.parquet(f"{cache}/counts-{len(tokens.appends(spark, cache))}")
    spark.createDataFrame([("other", r["digest"], 77) for r in rows], "version string, digest binary, n_tokens long").write.parquet(f"{cache}/counts-{len(tokens.appends(spark, cache))}")
    assert sorted(map(tuple, tokens.token_counts(docs, cache).collect())) == first
    more = docs.union(spark.createDataFrame([(5, "new")], docs.schema))
    assert len(tokens.token_counts(more, cache).collect()) == 5 and tokens._stored(spark, cache).count() == 10


def test_the_query_finds_stored_counts(spark):
    a = sorted(map(tuple, tokens.query(spark, SF).collect()))
    folder = f"{tokens.shared_dir(spark)}/token-counts"
    n = tokens._stored(spark, folder).count()
    assert sorted(map(tuple, tokens.query(spark, SF).collect())) == a and tokens._stored(spark, folder).count() == n
