"""Near-duplicates, repeated passages, decontamination and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from scholium.llm import components, debruijn, decontaminate, simhash, suffix_dedup, suffixes, windows

TEXTS = [None, "", " \n", "one", "one two three four five six", "ONE two three four five six"]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, h int, spans string, n int").repartition(3)


def corpus(seed, n=60, vocabulary=400):
    """Documents with copies, near copies, shared passages and repeats within a document."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rnd.choice(words) for _ in range(90)]
    out = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.choice([5, 60, 130, 400]))]
        kind = rnd.random()
        if kind < 0.15 and out:
            out.append(rnd.choice(out))
            continue
        if kind < 0.35 and out:
            body = rnd.choice(out).split()
            if body:
                body[rnd.randrange(len(body))] = rnd.choice(words)
        elif kind < 0.6:
            at = rnd.randrange(len(body) + 1)
            lo = rnd.randrange(40)
            body[at:at] = passage[lo : lo + rnd.choice([40, 49, 50, 51, 90])]
        elif kind < 0.7:
            body = body * 2
        out.append(" ".join(body))
    return out


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if (a ^ b).bit_count() <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("limit", [1 << 15, 4])
def test_simhash_components(spark, limit):
    texts = [*TEXTS, *corpus(3)]
    prints = [plain_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts), limit).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(range(len(texts)), prints)


def test_links_connect_what_pairs_connect(spark):
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    prints = set()
    for _ in range(300):
        p = rnd.choice(centres)
        for _ in range(rnd.randrange(6)):
            p ^= 1 << rnd.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(signed, prints)
    for limit in (1 << 15, 8):
        found = {r["node"]: r["component"] for r in components.components(simhash.links(classes, limit)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_pigeonring_never_loses_a_pair():
    rnd = random.Random(4)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randrange(5)):
            b ^= 1 << bit
        near = (a ^ b).bit_count() <= 3
        assert simhash._near(np.uint64(a), np.array([b], np.uint64))[0] == near


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "u long, v long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_rows_without_an_id_link_like_others(spark):
    """A row without an id may be the only bridge between two others, or have no id in reach."""
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    near = [words, words[:-1] + ["x"], words[:-2] + ["y", "z"]]
    texts = [*(" ".join(w) for w in near), "alone " * 9, "alone " * 9, "another lonely text of words"]
    ids = [None, 7, 4, None, None, 9]
    prints = [plain_fingerprint(t) for t in texts]
    group = plain_components(range(len(texts)), prints)
    want = [min((i for i, g in zip(ids, group.values()) if g == group[n] and i is not None), default=None) for n in range(len(texts))]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert sorted(map(str, ((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got))) == sorted(map(str, zip(ids, prints, want)))
    assert group[0] == group[1] and want[3] is None


def test_keep_one_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 5, 6), (None, "a b c d", 5, 6)], "_dropped long, text string, component_id long, doc_id long")
    docs = docs.select(F.col("_dropped").alias("doc_id"), "text", F.col("doc_id").alias("_dropped"), "component_id")
    kept = simhash.keep_one(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"] and kept.columns == docs.columns


def test_keep_one_of_each_group(spark):
    texts = ["a b c d e f g", "a b c d e f g", "quite another text of seven words"]
    kept = simhash.keep_one(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == frame(spark, texts).columns
    assert simhash.keep_one(frame(spark, texts).limit(0)).count() == 0


# repeated passages


def plain_word_removal(rows, length):
    first = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - length + 1):
            first.setdefault(tuple(split[d][i : i + length]), d)
    out = {}
    for d, words in split.items():
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(spark, seed):
    texts = [*TEXTS, *corpus(seed)]
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.remove_repeats(frame(spark, texts, ids)).collect()}
    assert got == plain_word_removal(zip(ids, texts), 50)
    assert any(n for _, n, _ in got.values())


def test_passage_that_repeats_within_a_document(spark):
    """Both places lose what a document of smaller id holds in part."""
    rnd = random.Random(8)
    passage = [f"p{rnd.randrange(500)}" for _ in range(160)]
    texts = [" ".join(passage[20:100]), " ".join([*passage, *(f"q{i}" for i in range(30)), *passage]), " ".join(passage[60:])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.remove_repeats(frame(spark, texts)).collect()}
    assert got == plain_word_removal(enumerate(texts), 50) and got[1][1] == 160


def test_repeated_words_of_short_windows(spark):
    """Small alphabets make branches, loops and equal seeds."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(40))) for _ in range(40)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.remove_repeats(frame(spark, texts), 8, 3).collect()}
    assert got == plain_word_removal(enumerate(texts), 8)
    assert debruijn.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def plain_byte_removal(rows, length):
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "shard"), [(1, 1 << 13), (2, 2)])
def test_repeated_bytes(spark, seed, shard):
    rows = list(enumerate([*TEXTS, "é" * 900, *corpus(seed)]))
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, [t for _, t in rows]), shard_blocks=shard).collect())
    assert got == plain_byte_removal(rows, 400)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("shard", [1 << 13, 2])
def test_repeated_bytes_of_short_windows(spark, shard):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(40)]
    df = frame(spark, [t for _, t in rows])
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(df, 14, 5, 4, shard).collect())
    assert got == plain_byte_removal(rows, 14)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_count_as_documents(spark):
    text = " ".join(f"word{i}" for i in range(80))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, [text, text], [7, 7])).collect()]
    assert [r[2] for r in got] == [len(text)] * 2
    same = [tuple(r) for r in debruijn.remove_repeats(frame(spark, [text, text], [7, 7])).collect()]
    assert [r[2] for r in same] == [0, 0]


def test_long_documents_run_over_blocks():
    parts = [x for block in windows.blocks([25, 3, 40], 5, block=12) for x in block]
    for doc, n in enumerate([25, 3, 40]):
        starts = [p for d, a, b in parts if d == doc for p in range(a, b - 4)]
        assert starts == list(range(max(0, n - 4)))


def test_suffix_arrays():
    rnd = random.Random(0)
    for _ in range(200):
        x = np.array([rnd.randint(0, rnd.choice([1, 3, 50])) for _ in range(rnd.randint(0, 60))], np.int64)
        plain = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        order, ranks = suffixes.suffix_array(x)
        assert plain == order.tolist()
        common = suffixes.common_prefixes(x, order, ranks)
        for k in range(1, len(plain)):
            a, b = x[plain[k - 1] :].tolist(), x[plain[k] :].tolist()
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common[k] == n


# decontamination


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_the_table():
    rnd = random.Random(3)
    for _ in range(500):
        a, b = ([rnd.randint(1, 4) for _ in range(rnd.randint(lo, hi))] for lo, hi in ((1, 12), (0, 20)))
        assert decontaminate.search(a, b)[0] == edits(a, b)


def test_recall_at_the_largest_distance(duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    filler = [w for (t,) in duck.sql("select text from documents limit 40").fetchall() for w in t.split()]
    rnd, index = random.Random(1), decontaminate.Items(items)
    texts, want = [], []
    for n in range(400):
        i = rnd.randrange(len(items))
        words = items[i][1].split()
        for _ in range(int(0.2 * len(words))):
            at = rnd.randrange(len(words))
            kind = rnd.randrange(3)
            words[at : at + (kind != 2)] = [] if kind == 0 else [rnd.choice(filler)]
        text = [*(rnd.choice(filler) for _ in range(rnd.choice([0, 30]))), *words, *(rnd.choice(filler) for _ in range(rnd.choice([0, 30])))]
        texts.append(" ".join(text))
        if edits([w.lower() for w in items[i][1].split()], [w.lower() for w in text]) <= int(0.2 * len(items[i][1].split())):
            want.append((n, i))
    got = {(d, i) for d, i, *_ in decontaminate.matches(index, texts)}
    assert len(want) > 300 and sum(x in got for x in want) / len(want) >= 0.97


def test_contamination_equals_brute_force(spark, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    docs = duck.sql("select doc_id, text from documents").fetchall()
    lower = lambda t: t.encode().lower().split()
    want = set()
    for d, t in docs:
        words = lower(t)
        for i, x in items:
            item = lower(x)
            if len(set(item) & set(words)) >= 0.3 * len(set(item)) and decontaminate.search(item, words)[0] <= int(0.2 * len(item) + 1e-9):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.query(spark, SF).collect()}
    assert set(got) == want and want
    texts, passages = dict(docs), dict(items)
    for (d, i), r in got.items():
        stretch = lower(texts[d])[r["start_word"] : r["end_word"]]
        assert r["similarity"] >= 0.8 and edits(lower(passages[i]), stretch) == r["edits"]


def test_decontamination_edges(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [*TEXTS, passage, passage.upper(), "x " + passage.replace("delta", "q") + " y", "alpha beta only"]
    bench = spark.createDataFrame([(1, passage, "t"), (1, passage, "t"), (2, None, "t"), (3, "", "t")], "item_id long, text string, doc_id string")
    got = sorted({(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contamination(frame(spark, texts), bench).collect()})
    n = len(TEXTS)
    assert got == [(n, 1, 0), (n + 1, 1, 0), (n + 2, 1, 1)]
    kept = decontaminate.keep_clean(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(n), n + 3]
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contamination(frame(spark, texts).limit(0), bench).count() == 0


def test_items_without_an_id_and_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    one, two = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda my ny"
    bench = spark.createDataFrame([(None, one), (5, two), (6, "single")], "item_id long, text string")
    texts = [f"x {one} y", two, f"{one} {two}", "a single word", "nothing of it"]
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    assert got == {(0, None, 1, 7), (1, 5, 0, 7), (2, None, 0, 6), (2, 5, 6, 13), (3, 6, 1, 2)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(frame(spark, texts), bench).collect()] == [4]


def test_a_long_item_and_a_long_text():
    rnd = random.Random(6)
    long = [f"w{rnd.randrange(300)}" for _ in range(3000)]
    items = decontaminate.Items([(1, " ".join(long)), (2, "p q r s t")])
    edited = [w if rnd.random() > 0.1 else "z" for w in long]
    text = " ".join([*(f"f{i}" for i in range(70_000)), *edited, "p q r s t"])
    got = {(d, i): (a, b) for d, i, a, b, _ in decontaminate.matches(items, ["", text, None])}
    assert set(got) == {(1, 0), (1, 1)} and got[1, 1] == (73_000, 73_005)
    assert abs(got[1, 0][0] - 70_000) < 10


# pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, duck):
    import corpus_pipeline

    from scholium.llm import bpe, pii, quality

    docs = dict(duck.sql("select doc_id, text from documents").fetchall())
    good = {r["doc_id"] for r in quality.query(spark, SF).filter("kept").collect()}
    ids = sorted(good)
    group = plain_components(ids, [plain_fingerprint(docs[i]) for i in ids])
    items = decontaminate.Items(duck.sql("select item_id, text from benchmark").fetchall())
    left = [i for i in ids if group[i] == i]
    dirty = {left[d] for d, *_ in decontaminate.matches(items, [docs[i] for i in left])}
    left = [i for i in left if i not in dirty]
    accepted = pii.accepted_of(spark.createDataFrame([(i, docs[i]) for i in left], "doc_id long, text string"))
    mask = pii._Redactor(accepted, ["doc_id", "text"]).mask
    want = {i: hashlib.sha256(mask(docs[i]).encode()).hexdigest() for i in left}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert bpe.load(bpe.default_path()).encode("")== []
