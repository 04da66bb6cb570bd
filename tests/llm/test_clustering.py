"""Clusters against plain rounds, bounds that only ever prune, and defined cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from scholium.llm import clustering as c

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string"


def plain(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        which = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in centroids]
            which.append((min(far), far.index(min(far))))
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, w) in zip(kept, which) if w == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    whole = sum(d for d, _ in which)
    return sorted(
        (str(i), w, d, sum(e for e, u in which if u == w), whole, hashlib.sha256(",".join(map(str, centroids[w])).encode()).hexdigest())
        for (i, _), (d, w) in zip(kept, which)
    )


def shown(df):
    return sorted((str(r["vec_id"]), *tuple(r)[1:]) for r in df.collect())


def vectors(seed, n, spread=0.2):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)], 1, "x") for i in range(n)]


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.2), (2, 1.0)])
def test_clusters(spark, seed, spread):
    rows = vectors(seed, 150, spread)
    rows += [(7, rows[3][1], 1, "x"), (None, rows[3][1], 1, "x"), (None, rows[4][1], 1, "x"), *[(500 + i, rows[0][1], 1, "x") for i in range(60)]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert shown(c.clusters(df)) == plain([r[:2] for r in rows])


def test_left_out_and_few(spark):
    good = [0.5] * 64
    rows = [(1, None), (2, []), (3, good[:63]), (4, [*good, 0.5]), (5, [None, *good[1:]]), (6, [float("nan"), *good[1:]]), (7, [float("-inf"), *good[1:]]), (8, good), (9, good), (9, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert shown(c.clusters(df)) == plain(rows) and len(plain(rows)) == 3
    assert c.clusters(df.filter("vec_id < 8")).count() == 0 and c.clusters(df.limit(0)).columns == c.clusters(df).columns
    with pytest.raises(Exception, match="too large"):
        c.clusters(spark.createDataFrame([(1, [3e6] * 64, 1, "x")], SCHEMA)).collect()


def test_ties_go_to_the_smaller_number(spark):
    """Vectors half-way between centroids, and equal centroids."""
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([0.0, 1 / 64, 2 / 64]) if j < 2 else 0.0 for j in range(64)], 1, "x") for i in range(200)]
    assert shown(c.clusters(spark.createDataFrame(rows, SCHEMA))) == plain([r[:2] for r in rows])


def test_bounds_prune_and_hold(spark):
    rows = vectors(3, 600)
    ints = c.integer_vectors(spark.createDataFrame(rows, SCHEMA)).cache()
    state, centroids = c.final_state(ints, c.first_centroids(ints), rounds=8)
    held = state.collect()
    assert sum(r["scanned"] for r in held) < len(held) / 2
    for r in held:
        far = np.sort(np.sqrt([float(((np.array(r["v"]) - m) ** 2).sum()) for m in centroids]))
        assert far[0] <= r["upper"] and (r["lower"] <= far[1])
