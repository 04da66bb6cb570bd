"""The pipeline's documents found without the product's code: rules by SQL, fingerprints, and edit distances by the plain table."""

from __future__ import annotations

from conftest import SF
from test_duplicates import edits, plain_components, plain_fingerprint

from scholium.llm import quality


def test_documents_of_the_pipeline(spark, duck):
    import corpus_pipeline

    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    rules = duck.sql(quality.ORACLE)
    at = {c: i for i, c in enumerate(rules.columns)}
    good = sorted(r[at["doc_id"]] for r in rules.fetchall() if r[at["kept"]])
    group = plain_components(good, [plain_fingerprint(docs[i]) for i in good])
    left = [i for i in good if group[i] == i]
    items = [t.encode().lower().split() for (t,) in duck.sql("select text from benchmark").fetchall() if t]

    def dirty(text):
        words = text.encode().lower().split()
        there = set(words)
        for item in items:
            most = int(0.2 * len(item) + 1e-9)
            # each word of the item that is nowhere in the text costs an edit
            if sum(w not in there for w in item) <= most and edits(item, words) <= most:
                return True
        return False

    want = [i for i in left if not dirty(docs[i])]
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) < len(left) < len(good) < len(docs)
