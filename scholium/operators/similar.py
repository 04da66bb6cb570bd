"""Joins of similar and of contained strings that do not form all pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Padding before and after a string; in a text they only add candidates.
_START, _END = "\x02", "\x03"


@F.pandas_udf(StringType())
def sorted_tokens(texts: pd.Series) -> pd.Series:
    """White-space tokens in sorted order."""
    return texts.map(lambda x: None if x is None else " ".join(sorted(x.split())))


@lru_cache(maxsize=1 << 12)
def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (|a| + |b|) by bit vectors; the first string's masks serve all its partners."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 100.0 * 2 * (full ^ row).bit_count() / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(DoubleType())
def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def gram_size(threshold: float) -> int:
    """The longest grams, three at most, of which strings at the threshold always share one."""
    return 3 if threshold >= 80 else 2 if 3 * threshold >= 200 else 1


def _grams(text: str, q: int) -> Column:
    """(gram, at) of a string, padded so that its ends count."""
    whole = F.concat(F.lit(_START * (q - 1)), text, F.lit(_END * (q - 1)))
    places = F.when(F.length(whole) >= q, F.sequence(F.lit(1), F.length(whole) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substring(whole, i, F.lit(q)).alias("gram"), i.alias("at")))


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of the strings ``a.s`` and ``b.s`` that share enough q-grams to reach the indel ratio.

    A ratio r of strings of m and n characters leaves L >= (m + n) r / 200 characters in common, in at most
    m + n - 2 L + 1 unbroken runs, and so L + (q - 1)(1 - (m + n - 2 L)) q-grams of the padded strings, each shifted by
    no more than the n - L insertions or m - L deletions allow. Of the first string's grams, rarest in the second
    table first, as many of the commonest are left out as the least such number less one: one of the others must hit,
    and the hits must reach what is then left of the number. Pairs that met by trigrams are then held to the number of
    pairs of characters, which is larger. Nothing is lost by any of these bounds.
    """
    if not threshold > 0:
        raise ValueError("every pair reaches a threshold of 0")
    q, least = gram_size(threshold), threshold / (200 - threshold)
    slope = (2 * q - 1) * threshold / 200 - (q - 1)
    left = a.select(F.col("s").alias("a")).distinct().withColumn("m", F.length("a"))
    right = b.select(F.col("s").alias("b")).distinct().withColumn("n", F.length("b"))
    posted = right.select("b", "n", F.explode(_grams("b", q)).alias("g")).select("b", "n", "g.gram", F.col("g.at").alias("at_b"))
    often = posted.groupBy("gram").agg(F.count("*").alias("df"))
    probes = left.select("a", "m", F.explode(_grams("a", q)).alias("g")).select("a", "m", "g.gram", F.col("g.at").alias("at_a"))
    ranked = probes.join(often, "gram", "left").groupBy("a", "m").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "at_a"))).alias("g")
    )
    spare = F.greatest(F.ceil((F.col("m") + F.ceil(F.col("m") * least - 1e-9)) * slope + (q - 1) - 1e-9) - 1, F.lit(0)).cast("int")
    kept = ranked.withColumn("spare", spare).withColumn("g", F.explode(F.slice("g", F.lit(1), F.greatest(F.size("g") - F.col("spare"), F.lit(0)))))
    kept = kept.filter("g.df > 0").select("a", "m", "spare", "g.gram", "g.at_a")
    common = F.ceil((F.col("m") + F.col("n")) * threshold / 200 - 1e-9)
    shift = F.col("at_b") - F.col("at_a")
    hits = kept.join(posted, "gram").withColumn("l", common).filter(
        (F.col("l") <= F.least("m", "n")) & (shift >= F.col("l") - F.col("m")) & (shift <= F.col("n") - F.col("l"))
    )
    needed = (2 * q - 1) * F.col("l") + (q - 1) * (1 - F.col("m") - F.col("n")) - F.col("spare")
    counted = hits.groupBy("a", "b", "m", "n", "l", "spare").agg(F.count("*").alias("k"))
    # pairs are small rows and dear to compare: spread over all cores, which their bytes would not do
    met = counted.filter(F.col("k") >= needed).repartition(a.sparkSession.sparkContext.defaultParallelism)
    if q == 3:
        whole = [F.concat(F.lit(_START), c, F.lit(_END)) for c in ("a", "b")]
        twos = F.filter(F.sequence(F.lit(1), F.col("m") + 1), lambda i: F.contains(whole[1], F.substring(whole[0], i, F.lit(2))))
        # asked of counted pairs only: without k in it, Spark would ask it of every hit
        met = met.filter(F.when(F.col("k") >= needed, F.size(twos)).otherwise(-1) >= 3 * F.col("l") + 1 - F.col("m") - F.col("n"))
    return met.select("a", "b")


def similar(texts: DataFrame, others: DataFrame, text: str, other: str, threshold: float) -> DataFrame:
    """(text, other, score): distinct strings of both tables whose token sort ratio reaches the threshold.

    Strings are compared in sorted order of their tokens, each distinct one once. White space alone is like nothing.
    """
    a = texts.select(text).distinct().withColumn("s", sorted_tokens(text))
    b = others.select(other).distinct().withColumn("s", sorted_tokens(other))
    scored = candidates(a.filter("s <> ''"), b.filter("s <> ''"), threshold).withColumn("score", indel_ratios("a", "b")).filter(F.col("score") >= threshold)
    empty = F.broadcast(a.sparkSession.createDataFrame([("", "", 100.0)], "a string, b string, score double"))  # a single row
    scored = scored.unionByName(empty)
    named = scored.join(a.withColumnRenamed("s", "a"), "a").join(b.withColumnRenamed("s", "b"), "b")
    return named.select(text, other, "score")


def _stretches(text: str) -> Column:
    """All stretches of one to three characters of a text, and the empty one."""
    n = F.length(text)
    parts = [F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(text), i, F.lit(k)))) for k in (1, 2, 3)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))


def _trigrams(text: str) -> Column:
    """The trigrams of a text, or the whole of one that is shorter."""
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_distinct(long)).otherwise(F.array(text))


def containing(holders: DataFrame, held: DataFrame, holder: str, inner: str, by: Sequence[str] = (), whole_words: bool = False) -> DataFrame:
    """Rows of both, equal in ``by``, where ``holder`` holds ``inner``.

    Every trigram of the inner text stands in its holders, so both meet by the one that fewest holders have, and inner
    texts with a trigram that no holder has meet none. With ``whole_words`` the parts are words. A beginning that all
    names have in common is never the rarest part, unless it is the whole of the inner text. Texts meet once each,
    whatever rows repeat them, and never as a broadcast: a text has many parts, which Spark's size estimate leaves out.
    """
    by = list(by)
    if whole_words:
        own, parts = F.array_distinct(F.split(F.col(holder), " ")), F.array_distinct(F.split(F.col(inner), " "))
        inside = F.contains(F.concat(F.lit(" "), holder, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))
    else:
        own, parts, inside = _stretches(holder), _trigrams(inner), F.contains(holder, F.col(inner))
    spread = holders.select(*by, holder).distinct().withColumn("_part", F.explode(own)).hint("merge")
    often = spread.groupBy(*by, "_part").agg(F.count("*").alias("_df")).hint("merge")
    wanted = held.select(*by, inner).distinct().withColumn("_n", F.size(parts)).withColumn("_part", F.explode(parts))
    rarest = wanted.join(often, [*by, "_part"]).groupBy(*by, inner, "_n").agg(F.count("*").alias("_k"), F.min_by("_part", F.struct("_df", "_part")).alias("_part"))
    met = spread.join(rarest.filter("_k = _n").select(*by, inner, "_part"), [*by, "_part"]).filter(inside).select(*by, holder, inner)
    return holders.join(met, [*by, holder]).join(held, [*by, inner])
