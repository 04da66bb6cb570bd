"""Agreement of raters: kappa, alpha, bias, grids of judges and systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kappa(pairs: DataFrame, by: list[str] | None = None, digits: int | None = 9) -> DataFrame:
    """Cohen's kappa of (a, b), per group; one category or chance agreement of 1 gives 1, no pairs no row.

    The confusion matrix is counted first; all else runs on its few cells.
    """
    by = by or []
    pairs = pairs.filter("a is not null and b is not null")
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, F.col("a").alias("c")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(*by, F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("o"))
    both = seen.join(chance, by, "left") if by else seen.join(F.broadcast(chance))
    po, pe = F.col("o") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((po - pe) / (1 - pe))
    return both.filter("n > 0").select(*by, "n", (value if digits is None else F.round(value, digits)).alias("kappa"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def alpha_ordinal(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha of (unit, rater, score) with ordinal distances; units with one score do not count.

    Observed disagreement is the mean distance over pairs within units; pairs are counted per category, so no
    unit's pairs are listed. Expected disagreement takes all scores' frequencies, without a small-sample factor.
    """
    several = ratings.filter("score is not null").groupBy("unit", "score").agg(F.count("*").alias("n"))
    total = several.groupBy("unit").agg(F.sum("n").alias("m")).filter("m > 1")
    kept = several.join(total.select("unit"), "unit", "left_semi")
    freq = kept.groupBy("score").agg(F.sum("n").alias("f"))
    upto = freq.withColumn("cum", F.sum("f").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lo = upto.select(F.col("score").alias("c"), F.col("f").alias("fc"), F.col("cum").alias("cc"))
    hi = upto.select(F.col("score").alias("k"), F.col("f").alias("fk"), F.col("cum").alias("ck"))
    between = F.col("ck") - F.col("cc") + F.col("fc") - F.col("fc") / 2 - F.col("fk") / 2
    dist = lo.join(hi, F.col("c") < F.col("k")).withColumn("d", between * between)
    pairs = kept.select("unit", F.col("score").alias("c"), F.col("n").alias("nc")).join(
        kept.select("unit", F.col("score").alias("k"), F.col("n").alias("nk")), "unit"
    ).filter("c < k").groupBy("c", "k").agg(F.sum(F.col("nc") * F.col("nk")).alias("w"))
    observed = pairs.join(dist, ["c", "k"]).agg(F.coalesce(F.sum(F.col("w") * F.col("d")), F.lit(0.0)).alias("o"))
    in_unit = total.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("np"))
    expected = dist.agg(F.coalesce(F.sum(2 * F.col("fc") * F.col("fk") * F.col("d")), F.lit(0.0)).alias("e"))
    n = freq.agg(F.sum("f").alias("n"))
    one = observed.join(in_unit).join(expected).join(n)
    do, de = F.try_divide("o", "np"), F.try_divide("e", F.col("n") * F.col("n"))
    return one.select(F.round(F.when(F.coalesce(de, F.lit(0.0)) == 0, 1.0).otherwise(1 - do / de), 9).alias("alpha"))


def alpha_variance(ratings: DataFrame) -> DataFrame:
    """Alpha by squared differences: the mean within units against twice the population variance."""
    rows = ratings.filter("score is not null")
    unit = rows.groupBy("unit").agg(F.count("*").alias("m"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")).filter("m > 1")
    # the sum of squared differences of all pairs of a unit is m * q - s^2
    within = unit.agg(F.sum(F.col("m") * F.col("q") - F.col("s") * F.col("s")).alias("w"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("np"))
    kept = rows.join(unit.select("unit"), "unit", "left_semi").agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")
    )
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    value = F.when(variance <= 0, 1.0).otherwise(1 - F.col("w") / F.col("np") / (2 * variance))
    return within.join(kept).select(F.round(value, 9).alias("alpha"))


def bias(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("a") - F.col("b")).cast("double")).alias("bias"), F.count("*").alias("n"))


def judge_grid(scores: DataFrame) -> DataFrame:
    """(j1, j2, system, n, kappa) of every two judges on each system, and their mean over systems as system ``all``."""
    pairs = scores.select("unit", "system", F.col("judge").alias("j1"), F.col("score").alias("a")).join(
        scores.select("unit", "system", F.col("judge").alias("j2"), F.col("score").alias("b")), ["unit", "system"]
    ).filter("j1 < j2")
    per = kappa(pairs, ["j1", "j2", "system"], None)
    mean = per.groupBy("j1", "j2").agg(F.sum("n").alias("n"), F.avg("kappa").alias("kappa"))
    both = per.union(mean.select("j1", "j2", F.lit("all").alias("system"), "n", "kappa"))
    return both.withColumn("kappa", F.round("kappa", 9))


def judge_bias(scores: DataFrame) -> DataFrame:
    """(judge, system, bias): a judge's mean against the mean of all judges' means, missing ones as 0."""
    per = scores.groupBy("judge", "system").agg(F.avg("score").alias("mean"))
    grid = scores.select("judge").distinct().join(scores.select("system").distinct())
    full = grid.join(per, ["judge", "system"], "left")
    ensemble = F.avg(F.coalesce("mean", F.lit(0.0))).over(Window.partitionBy("system"))
    ranked = full.withColumn("e", ensemble)
    return ranked.select("judge", "system", F.round(F.coalesce("mean", "e") - F.col("e"), 9).alias("bias"))


def pair_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """(paper_id, score): 0, 1 or 2 as the Jaccard of both annotators' (name, aff) is below a half, below 1, or 1."""
    tag = a.select("paper_id", "name", "aff", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("paper_id", "name", "aff", F.lit(0), F.lit(1)))
    one = tag.groupBy("paper_id", "name", "aff").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    by = one.groupBy("paper_id").agg((F.sum(F.col("x") * F.col("y")) / F.count("*")).alias("j"))
    return by.select("paper_id", F.when(F.col("j") < 0.5, 0).when(F.col("j") < 1, 1).otherwise(2).alias("score"))
