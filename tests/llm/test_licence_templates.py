"""Licence templates are all verified or refuted, whatever stands in a document or in the corpus around it."""

from __future__ import annotations

import random

from scholium.llm import licenses

INDEX = licenses.Index()


def hits(text):
    return {n: INDEX.number[w] for n, w in enumerate(licenses.words(text)) if w in INDEX.number}


def every_start(text):
    """Each template laid at each start."""
    found, best = [w.decode() for w in licenses.words(text)], {}
    for t in licenses.TEMPLATES:
        tokens = t.text.split()
        rare = [k for k, w in enumerate(tokens) if w not in licenses.COMMON]
        word = {n: w for n, w in enumerate(found)}.get
        for start in range(-len(tokens), len(found)):
            votes = sum(word(start + k) == tokens[k] for k in rare)
            phrases = all(any([word(at + k) for k in range(len(p.split()))] == p.split() for at in range(start, start + len(tokens))) for p in t.phrases)
            score = sum(word(start + k) == w for k, w in enumerate(tokens)) / len(tokens)
            if votes >= min(licenses.LEAST_VOTES, len(rare)) and phrases and score >= licenses.LEAST_SCORE:
                best[t.label] = max(best.get(t.label, 0.0), score)
    return best


def test_a_document_of_all_templates_has_all_labels(spark):
    text = " . ".join(f"part {n} {t.text}" for n, t in enumerate(licenses.TEMPLATES))
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = licenses.scan(docs).first()
    assert set(got["labels"].split(",")) == {t.label for t in licenses.TEMPLATES} | set(licenses.BASE.values())


def test_labels_do_not_depend_on_the_corpus():
    rng = random.Random(5)
    vocabulary = [w for t in licenses.TEMPLATES for w in t.text.split()]
    for _ in range(300):
        parts = [rng.choice(licenses.TEMPLATES).text.split() for _ in range(rng.randint(1, 8))]
        for p in parts:
            for _ in range(rng.randint(0, 3)):
                p[rng.randrange(len(p))] = rng.choice([*vocabulary, "other"])
        text = " ".join(w for p in parts for w in [*p, *["pad"] * rng.randint(0, 2)])
        want = every_start(text)
        for _ in range(2):
            idf = {n: rng.random() for n in range(len(INDEX.vocabulary))}
            assert INDEX.matches(hits(text), idf) == want
