"""Licence scans through a positional index of rare words.

Templates are short licence statements. The index holds, for each template, the places of its rare words. A
template is laid where at least ``LEAST_VOTES`` of its rare words stand in place, so one of them is among all
but ``LEAST_VOTES - 1`` of its rare places: those whose words have the highest inverse document frequency
(counted over the whole corpus) are looked up in the file, and each of their sights names the start at which the
template would lie. There the rare words are counted, the template's mandatory phrases must stand, and the share
of its words found in place is its score. The frequencies only order the lookups, words of equal frequency by their
place in the template; no start that could match is left out, so a text's labels do not depend on the corpus around
it.

A text's score is the best of its templates' scores. Where only a base phrase stands, it is the share that the phrase
makes up of the shortest template around it. Of equal scores of a label one counts.

Defined cases: a null or empty text has no words, no labels and score 0. Repeated rows are scanned row by row.
An empty table gives an empty result; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import id_text, materialize, table

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A licence statement: all of ``phrases`` must stand in it word for word; the rest may differ in part."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Licence statements in common use, lower case, without punctuation.
TEMPLATES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use", "source and binary forms"),
    ),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0", ("public domain", "cc0")),
)
#: Template words too frequent in prose to start a lookup; they still count when a template is verified.
COMMON = frozenset(
    "the of to in a is and are or by for from with this any under use free form forms without subject terms version person "
    "sa nc nd v 0 1 2 3 4 charge copy source granted permitted".split()
)
LEAST_VOTES, LEAST_SCORE = 2, 0.6
_CLEAN = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_CLEAN).split()


class Index:
    """Postings of template words, and the words whose sight makes a file worth recording."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, base: Mapping[str, str] = BASE):
        self.templates = templates
        self.tokens = [t.text.split() for t in templates]
        self.phrases = [[p.split() for p in t.phrases] for t in templates]
        self.base = [(p.split(), label) for p, label in base.items()]
        vocabulary = dict.fromkeys(w for t in self.tokens for w in t)
        vocabulary |= dict.fromkeys(w for p, _ in self.base for w in p)
        vocabulary |= dict.fromkeys(w for ps in self.phrases for p in ps for w in p)
        self.vocabulary = list(vocabulary)
        self.number = {w.encode(): n for n, w in enumerate(self.vocabulary)}
        self.anchors = frozenset(w.encode() for w in self.vocabulary if w not in COMMON)
        self.rare = {n for w, n in self.number.items() if w in self.anchors}
        self.ids = [self._ids(tokens) for tokens in self.tokens]
        self.phrase_ids = [[self._ids(p) for p in ps] for ps in self.phrases]
        self.mandatory = [frozenset(w for p in ps for w in p) for ps in self.phrase_ids]
        #: Of each template the (place, word) of its rare words, and how many of them must stand in place.
        self.rare_places = [[(at, w) for at, w in enumerate(ids) if w in self.rare] for ids in self.ids]
        self.least = [min(LEAST_VOTES, len(places)) for places in self.rare_places]
        #: What a base phrase alone is worth.
        self.alone = {
            label: max((len(p) / len(t) for t in self.tokens if any(t[k : k + len(p)] == p for k in range(len(t)))), default=0.5)
            for p, label in self.base
        }

    def _ids(self, phrase: Sequence[str]) -> list[int]:
        return [self.number[w.encode()] for w in phrase]

    def places(self, hits: Mapping[int, int]) -> list[tuple[int, str]]:
        """(start, label) wherever a base phrase's words stand consecutively; ``hits`` maps a place to its word."""
        by_word = defaultdict(list)
        for at, w in hits.items():
            by_word[w].append(at)
        out = []
        for phrase, label in self.base:
            ids = self._ids(phrase)
            out += [(at, label) for at in by_word[ids[0]] if all(hits.get(at + k) == w for k, w in enumerate(ids))]
        return out

    def matches(self, hits: Mapping[int, int], idf: Mapping[int, float]) -> dict[str, float]:
        """Best score of each label whose template stands in the file."""
        by_word = defaultdict(list)
        for at, w in hits.items():
            by_word[w].append(at)
        best: dict[str, float] = {}
        for t, tokens in enumerate(self.ids):
            if not self.mandatory[t] <= by_word.keys():
                continue
            places, least = self.rare_places[t], self.least[t]
            order = sorted(places, key=lambda x: (-idf.get(x[1], math.inf), x))
            looked_up = order[: len(order) - least + 1]
            for start in {at - place for place, w in looked_up for at in by_word.get(w, ())}:
                if sum(hits.get(start + place) == w for place, w in places) < least:
                    continue
                span = range(start, start + len(tokens))
                if not all(any(all(hits.get(at + k) == w for k, w in enumerate(p)) for at in span) for p in self.phrase_ids[t]):
                    continue
                score = sum(hits.get(start + k) == w for k, w in enumerate(tokens)) / len(tokens)
                if score >= LEAST_SCORE:
                    label = self.templates[t].label
                    best[label] = max(best.get(label, 0.0), score)
        return best


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Words, base places, labels and score of each document."""
    index = Index(templates)

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.number
        for batch in batches:
            counts, at, which = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                counts.append(len(found))
                if index.anchors.isdisjoint(found):
                    at.append([])
                    which.append([])
                else:
                    hits = [(n, number[w]) for n, w in enumerate(found) if w in number]
                    at.append([n for n, _ in hits])
                    which.append([w for _, w in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "at", "which"],
            )

    schema = "doc_id long, n_words long, at array<int>, which array<int>"
    hits = materialize(id_text(docs).mapInArrow(record, schema), "licence-hits")
    total = hits.count()
    # one row for each word of the index, whatever the corpus
    frequency = hits.select(F.explode(F.array_distinct("which")).alias("w")).groupBy("w").count().collect()
    idf = {r["w"]: math.log((total + 1) / (r["count"] + 0.5)) for r in frequency}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, which in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not at:
                    rows.append((0, None, None, "", "", 0.0))
                    continue
                here = dict(zip(at, which))
                base = index.places(here)
                more = index.matches(here, idf)
                own = {label for _, label in base}
                starts = [s for s, _ in base]
                score = max([*more.values(), *(index.alone[label] for label in own)], default=0.0)
                rows.append(
                    (len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                     ",".join(sorted(own | more.keys())), score)
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return hits.mapInArrow(
        judge,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
