"""Labels and scores against every template at every place."""

from __future__ import annotations

import random

from scholium.llm import licenses


def plain(text):
    """(labels, score) with nothing looked up: each template is laid at each place."""
    words = [w.decode() for w in licenses.words(text)]
    labels, score = set(), 0.0
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        if any(words[k : k + len(p)] == p for k in range(len(words))):
            labels.add(label)
            around = [t.text.split() for t in licenses.TEMPLATES if f" {phrase} " in f" {t.text} "]
            score = max(score, len(p) / min(map(len, around)))
    for t in licenses.TEMPLATES:
        tokens = t.text.split()
        rare = [k for k, w in enumerate(tokens) if w not in licenses.COMMON]
        for start in range(-len(tokens), len(words)):
            same = [k for k, w in enumerate(tokens) if 0 <= start + k < len(words) and words[start + k] == w]
            span = range(max(start, 0), start + len(tokens))
            stand = all(any(words[k : k + len(p)] == p for k in span) for p in (x.split() for x in t.phrases))
            share = len(same) / len(tokens)
            if stand and share >= licenses.LEAST_SCORE and sum(k in rare for k in same) >= min(licenses.LEAST_VOTES, len(rare)):
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_scores(spark):
    rnd = random.Random(11)
    pool = [w for t in licenses.TEMPLATES for w in t.text.split()] + ["foo", "bar", "Über", "x"]
    texts = [None, "", "Apache License", "CC BY", "the MIT license!"]
    for _ in range(400):
        parts = []
        for _ in range(rnd.randrange(4)):
            words = rnd.choice(licenses.TEMPLATES).text.split()
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randrange(2)] = [rnd.choice(pool)] * rnd.randrange(2)
            parts += [*words, *rnd.choices(pool, k=rnd.randrange(3))]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    want = {n: plain(t) for n, t in enumerate(texts)}
    assert got == want and len({labels for labels, _ in want.values()}) > 20
