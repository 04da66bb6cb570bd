"""Extraction quality: per-paper and macro scores, calibration, intervals, spending."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def paper_scores(gold: DataFrame, pred: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """(paper_id, precision, recall, f1) over distinct (name, aff).

    Nothing on both sides is 1, 1, 1; no gold is 0, 1, 0; no prediction is 1, 0, 0. ``papers`` adds those with
    neither.
    """
    keys = ["paper_id", "name", "aff"]
    tagged = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*keys, F.lit(0), F.lit(1)))
    pairs = tagged.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    by = pairs.groupBy("paper_id").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    if papers is not None:
        by = papers.select("paper_id").join(by, "paper_id", "left").select("paper_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("g", "p", "tp")))
    g, p = F.col("g"), F.col("p")
    both = by.select(
        "paper_id",
        F.when((g == 0) & (p == 0), 1.0).when(g == 0, 0.0).when(p == 0, 1.0).otherwise(F.try_divide("tp", "p")).alias("precision"),
        F.when(g == 0, 1.0).when(p == 0, 0.0).otherwise(F.try_divide("tp", "g")).alias("recall"),
        ((g == 0) & (p == 0)).alias("_none"),
    )
    score = F.when(F.col("_none"), 1.0).otherwise(f1(F.col("precision"), F.col("recall")))
    return both.select("paper_id", "precision", "recall", score.alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """Mean of each score over papers, and their number."""
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count("*").alias("n_scored"))


def surface_f1(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(paper_id, f1) of the multisets of ``token`` on both sides; both empty is not listed, one empty is 0."""
    g = gold.groupBy("paper_id", "token").agg(F.count("*").alias("g"))
    p = pred.groupBy("paper_id", "token").agg(F.count("*").alias("p"))
    both = g.join(p, ["paper_id", "token"], "full_outer").select("paper_id", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    by = both.groupBy("paper_id").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.least("g", "p")).alias("tp"))
    return by.select("paper_id", (2 * F.col("tp") / (F.col("g") + F.col("p"))).alias("f1"))


def last_by_name(pred: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    """Per paper and name the attributes of the last prediction."""
    return pred.groupBy("paper_id", "name").agg(*(F.max_by(c, pos).alias(c) for c in columns))


def attribute_accuracy(gold: DataFrame, pred: DataFrame, column: str, distinct: bool = False, fold: bool = False) -> DataFrame:
    """(paper_id, accuracy) over gold rows with ``column``; ``distinct`` counts each name once, ``fold`` ignores case.

    ``pred`` has one row per paper and name. A paper without such rows has accuracy 1.
    """
    value = F.upper if fold else (lambda c: F.col(c) if isinstance(c, str) else c)
    rows = gold.filter(F.col(column).isNotNull()).select("paper_id", "name", F.col(column).alias("want"))
    rows = rows.dropDuplicates(["paper_id", "name"]) if distinct else rows
    joined = rows.join(pred.select("paper_id", "name", F.col(column).alias("got")), ["paper_id", "name"], "left")
    right = F.coalesce(value("want").eqNullSafe(value("got")) & F.col("got").isNotNull(), F.lit(False))
    scored = joined.groupBy("paper_id").agg(F.avg(right.cast("double")).alias("accuracy"))
    return gold.select("paper_id").distinct().join(scored, "paper_id", "left").select("paper_id", F.coalesce("accuracy", F.lit(1.0)).alias("accuracy"))


def all_correct(scores: list[DataFrame]) -> DataFrame:
    """Share of papers on which every given score is 1; each frame is (paper_id, score)."""
    out = None
    for s in scores:
        one = s.groupBy("paper_id").agg((F.min("score") == 1.0).alias("right"))
        out = one if out is None else out.union(one)
    per_paper = out.groupBy("paper_id").agg(F.every("right").alias("right"))
    return per_paper.agg(F.avg(F.col("right").cast("double")).alias("all_correct_rate"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of (confidence, correct) over equal bins; a confidence of 1 falls in the last."""
    bin_ = F.least((F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    exact = F.col("confidence").cast("decimal(20,10)")
    by = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(exact).cast("double").alias("c"), F.sum(F.col("correct").cast("long")).alias("k"))
    total = by.agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("c") - F.col("k"))).alias("gap"))
    return total.select(F.round(F.coalesce(F.try_divide("gap", "n"), F.lit(0.0)), 9).alias("ece"), F.coalesce("n", F.lit(0)).alias("n"))


def micro(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Counts over all papers: authors found, missed, invented; affiliations of found ones right or wrong.

    A wrong affiliation counts as false positive only. Names match by equality; match them fuzzily before.
    """
    g = gold.groupBy("paper_id", "name").agg(F.min("aff").alias("want"), F.min("country").alias("want_country"))
    p = pred.groupBy("paper_id", "name").agg(F.min("aff").alias("got"), F.min("country").alias("got_country"))
    both = g.join(p, ["paper_id", "name"], "full_outer")
    found = F.col("want").isNotNull() & F.col("got").isNotNull()
    same, land = F.col("want") == F.col("got"), F.col("want_country") == F.col("got_country")
    n = both.agg(
        F.count_if(found).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("got").isNull()).alias("fn"),
        F.count_if(found & same).alias("aff_tp"), F.count_if(found & ~same).alias("aff_fp"), F.count_if(found & land).alias("country_right"),
        F.count_if(found & same & land).alias("both_right"),
    )
    p_, r_ = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    zero = F.lit(0.0)
    return n.select(
        "*", F.coalesce(p_, zero).alias("precision"), F.coalesce(r_, zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("fp"), F.col("tp") + F.col("fp")), zero).alias("hallucination_rate"),
        F.coalesce(F.try_divide("both_right", "tp"), zero).alias("hierarchical"),
    )


def stage_rates(attempts: DataFrame) -> DataFrame:
    """(stage, attempts, successes, rate), and all of them together."""
    by = attempts.rollup("stage").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"))
    return by.select(F.coalesce("stage", F.lit("overall")).alias("stage"), "attempts", "successes", F.try_divide("successes", "attempts").alias("rate"))


def outcomes(papers: DataFrame) -> DataFrame:
    """Papers fully done (completed with something normalised), partly done (completed), failed."""
    kind = F.when(F.col("completed") & F.col("normalised"), "full").when(F.col("completed"), "partial").otherwise("failed")
    return papers.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def engineering(runs: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Mean time, cost at prices per million tokens, calls, cache hits."""
    return runs.agg(
        F.avg("millis").alias("avg_millis"),
        ((F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6).alias("cost"),
        F.count("*").alias("calls"), F.try_divide(F.count_if("cached"), F.count("*")).alias("cache_hit_rate"),
    )


def quality_score(author_f1: Column, aff_f1: Column, hierarchical: Column, end_to_end: Column, seconds: Column) -> Column:
    """.60 of the extraction scores where any author was found, .25 of completion, .15 of pace.

    Without a known time the pace term is left out and the others make up the whole.
    """
    quality = F.when(author_f1 > 0, 0.3 * author_f1 + 0.3 * aff_f1 + 0.4 * hierarchical).otherwise(0.0)
    base = 0.60 * quality + 0.25 * end_to_end
    return F.when(seconds.isNull(), base / 0.85).otherwise(base + 0.15 * F.least(F.lit(1.0), 60 / F.greatest(seconds, F.lit(1.0))))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; (0, 0) without trials."""
    p = F.try_divide(k, n)
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def bootstrap(scores: DataFrame, key: str, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """(key, mean, low, high): percentile interval of the mean per system.

    Equal values of a system are counted first, and a round draws how often each distinct value comes up, which
    is the same as drawing its rows one by one; so a system's task holds its distinct values, not its papers.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        values, counts = pdf[value].to_numpy(float), pdf["n"].to_numpy()
        rng, n = np.random.default_rng(seed), int(counts.sum())
        step = max(1, 1_000_000 // len(values))
        drawn = [rng.multinomial(n, counts / n, size=min(step, rounds - at)) @ values / n for at in range(0, rounds, step)]
        means = np.sort(np.concatenate(drawn))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [values @ counts / n], "low": [means[int(0.025 * rounds)]], "high": [means[int(0.975 * rounds)]]})

    kind = scores.schema[key].dataType.simpleString()
    counted = scores.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).applyInPandas(run, f"{key} {kind}, mean double, low double, high double")


def hypothesis(delta: Column, low: Column, threshold: float) -> Column:
    """Supported where the gain reaches the threshold and its interval stays above zero."""
    return F.when(delta.isNull(), "not_evaluated").when((delta >= threshold) & (low > 0), "supported").when(delta >= threshold, "inconclusive").otherwise("rejected")


def ablation(scores: DataFrame, base: str) -> DataFrame:
    """(system, f1, delta) against the base system; null where it is missing."""
    of_base = scores.filter(F.col("system") == base).agg(F.max("f1").alias("b"))
    return scores.join(F.broadcast(of_base)).select("system", "f1", (F.col("f1") - F.col("b")).alias("delta"))


def leaderboard(scores: DataFrame) -> DataFrame:
    order = Window.orderBy(F.desc("f1"), "system")
    return scores.withColumn("rank", F.row_number().over(order))


def spend(charges: DataFrame, ceiling: float) -> DataFrame:
    """Running cost per budget in order; the first row past the ceiling and all later are flagged."""
    order = Window.partitionBy("budget").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return charges.withColumn("spent", F.sum("cost").over(order)).withColumn("over", F.col("spent") > ceiling)


def replay(charges: DataFrame, ceiling: int) -> DataFrame:
    """(budget, accepted, spent) where a rejected charge costs nothing, so that a later smaller one may pass.

    Costs are whole units; the charges of one budget are folded in order within a row.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "cost"))), lambda x: x["cost"])
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.lit(0).cast("bigint").alias("accepted"))

    def step(acc: Column, cost: Column) -> Column:
        fits = acc["spent"] + cost <= ceiling
        return F.struct(
            (acc["spent"] + F.when(fits, cost).otherwise(0)).cast("bigint").alias("spent"),
            (acc["accepted"] + F.when(fits, 1).otherwise(0)).cast("bigint").alias("accepted"),
        )

    folded = charges.groupBy("budget").agg(F.aggregate(listed, start, step).alias("x"))
    return folded.select("budget", "x.spent", "x.accepted")


def ledger(charges: DataFrame, prices: DataFrame, fallback: tuple[float, float], ceiling: float) -> DataFrame:
    """Cost, remaining budget and calls over all models; models without a price pay the fallback."""
    priced = charges.join(prices, "model", "left")
    cost = F.col("tokens_in") * F.coalesce("price_in", F.lit(fallback[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(fallback[1]))
    return priced.agg(F.sum(cost).alias("cost"), F.count("*").alias("calls")).withColumn("remaining", F.lit(ceiling) - F.col("cost"))


def calls_left(remaining: Column, cost: Column) -> Column:
    return F.floor(F.try_divide(remaining, cost)).cast("long")


def annotation_status(papers: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per year the papers annotated by both, one or none."""
    marked = papers.join(a.select("paper_id", F.lit(1).alias("a")).distinct(), "paper_id", "left").join(b.select("paper_id", F.lit(1).alias("b")).distinct(), "paper_id", "left")
    done, some = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a").isNotNull() | F.col("b").isNotNull()
    return marked.groupBy("year").agg(F.count_if(done).alias("done"), F.count_if(some & ~done).alias("partial"), F.count_if(~some).alias("missing"))
