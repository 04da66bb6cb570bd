"""Extraction metrics and rater agreement over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.operators import agreement as g
from scholium.operators import metrics as m
from scholium.plans.catalog import query
from scholium.sources import testdata as t
from scholium.sources.testdata import sql

_SCORES = """, ps AS (SELECT paper_id, count(*) FILTER (gg > 0) AS g, count(*) FILTER (pp > 0) AS p, count(*) FILTER (gg > 0 AND pp > 0) AS tp FROM
  (SELECT paper_id, name, aff, sum(x) AS gg, sum(y) AS pp FROM (SELECT paper_id, name, aff, 1 AS x, 0 AS y FROM gold UNION ALL SELECT paper_id, name, aff, 0, 1 FROM pred) GROUP BY ALL) GROUP BY 1),
pr AS (SELECT paper_id, CASE WHEN coalesce(g, 0) = 0 AND coalesce(p, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(g, 0) = 0 THEN 0.0 WHEN p = 0 THEN 1.0 ELSE tp / p END AS precision,
  CASE WHEN coalesce(g, 0) = 0 THEN 1.0::DOUBLE WHEN p = 0 THEN 0.0 ELSE tp / g END AS recall, coalesce(g, 0) + coalesce(p, 0) = 0 AS none FROM paper LEFT JOIN ps USING (paper_id)),
scores AS (SELECT paper_id, precision, recall, CASE WHEN none THEN 1.0::DOUBLE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
"""


def _scores(spark, d):
    return m.paper_scores(t.gold(spark, d), t.predicted(spark, d), t.papers(spark, d))


@query("a13_paper_scores", sql(_SCORES + "SELECT paper_id, precision, recall, f1 FROM scores"))
def _(spark, d):
    return _scores(spark, d)


@query("a14_macro_average", sql(_SCORES + "SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, count(*)::BIGINT AS n_scored FROM scores"))
def _(spark, d):
    s = m.macro(_scores(spark, d))
    return s.select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "n_scored")


@query("a15_surface_f1", sql("""SELECT paper_id, 2 * sum(least(g, p))::BIGINT / (sum(g) + sum(p))::BIGINT AS f1 FROM (SELECT coalesce(x.paper_id, y.paper_id) AS paper_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p
  FROM (SELECT paper_id, aff, count(*) AS g FROM gold GROUP BY ALL) x FULL JOIN (SELECT paper_id, aff, count(*) AS p FROM pred GROUP BY ALL) y ON x.paper_id = y.paper_id AND x.aff = y.aff) GROUP BY 1"""))
def _(spark, d):
    token = F.col("aff").alias("token")
    return m.surface_f1(t.gold(spark, d).select("paper_id", token), t.predicted(spark, d).select("paper_id", token))


def _attributes(spark, d):
    a = t.authors(spark, d).join(t.institutions(spark, d), "inst_id")
    gold = t.gold(spark, d).join(a.select(F.col("author_id").alias("name"), "country", "org_type", F.when(F.col("inst_id") % 4 != 0, F.col("inst_id")).alias("ror_id")), "name")
    pred = t.predicted(spark, d).withColumn("pos", F.col("aff")).join(t.institutions(spark, d).select(F.col("inst_id").cast("long").alias("aff"), F.lower("country").alias("country"), "org_type"), "aff")
    pred = pred.withColumn("ror_id", F.col("aff").cast("int"))
    return gold, m.last_by_name(pred, ["country", "org_type", "ror_id"])


_ATTR = """, gx AS (SELECT gold.*, country, org_type, CASE WHEN inst.inst_id % 4 <> 0 THEN inst.inst_id END AS ror_id FROM gold JOIN author ON author_id = gold.name JOIN inst USING (inst_id)),
px AS (SELECT paper_id, name, lower(inst.country) AS country, org_type, aff AS ror_id FROM (SELECT paper_id, name, max(aff) AS aff FROM pred GROUP BY ALL) JOIN inst ON inst_id = aff)
SELECT g.paper_id, coalesce(accuracy, 1.0::DOUBLE) AS accuracy FROM (SELECT DISTINCT paper_id FROM gx) g LEFT JOIN
  (SELECT x.paper_id, avg(CASE WHEN {same} THEN 1.0 ELSE 0.0 END) AS accuracy FROM {rows} x LEFT JOIN px USING (paper_id, name) WHERE {has} GROUP BY 1) USING (paper_id)"""


@query("a16_ror_accuracy", sql(_ATTR.format(same="x.ror_id = px.ror_id", rows="(SELECT DISTINCT paper_id, name, ror_id FROM gx)", has="x.ror_id IS NOT NULL")))
def _(spark, d):
    return m.attribute_accuracy(*_attributes(spark, d), "ror_id", distinct=True)


@query("a17_country_accuracy", sql(_ATTR.format(same="upper(x.country) = upper(px.country)", rows="gx", has="x.country IS NOT NULL")))
def _(spark, d):
    return m.attribute_accuracy(*_attributes(spark, d), "country", fold=True)


@query("a18_type_accuracy", sql(_ATTR.format(same="x.org_type = px.org_type", rows="gx", has="x.org_type IS NOT NULL")))
def _(spark, d):
    return m.attribute_accuracy(*_attributes(spark, d), "org_type")


@query("a19_all_correct", sql(_SCORES + "SELECT avg(CASE WHEN f1 = 1 AND precision = 1 THEN 1.0 ELSE 0.0 END) AS all_correct_rate FROM scores"))
def _(spark, d):
    s = _scores(spark, d)
    return m.all_correct([s.select("paper_id", F.col("f1").alias("score")), s.select("paper_id", F.col("precision").alias("score"))])


_ECE = """SELECT round(sum(abs(c - k)) / sum(n)::BIGINT, 9) AS ece, sum(n)::BIGINT AS n FROM (SELECT least(trunc(confidence * 10)::INT, 9) AS b, count(*) AS n,
  sum(confidence::DECIMAL(20,10))::DOUBLE AS c, count(*) FILTER (correct) AS k FROM (SELECT confidence, {how} AS correct FROM pred) GROUP BY 1)"""


@query("a20_calibration_error", sql(_ECE.format(how="EXISTS (SELECT 1 FROM gold g WHERE g.paper_id = pred.paper_id AND g.name = pred.name)")))
def _(spark, d):
    known = t.gold(spark, d).select("paper_id", "name", F.lit(True).alias("hit")).distinct()
    rows = t.predicted(spark, d).join(known, ["paper_id", "name"], "left")
    return m.calibration_error(rows.select("confidence", F.coalesce("hit", F.lit(False)).alias("correct")))


@query("a21_strict_calibration_error", sql(_ECE.format(how="EXISTS (SELECT 1 FROM gold g WHERE g.paper_id = pred.paper_id AND g.name = pred.name AND g.aff = pred.aff)")))
def _(spark, d):
    known = t.gold(spark, d).withColumn("hit", F.lit(True))
    rows = t.predicted(spark, d).join(known, ["paper_id", "name", "aff"], "left")
    return m.calibration_error(rows.select("confidence", F.coalesce("hit", F.lit(False)).alias("correct")))


@query("a22_micro_metrics", sql(""", x AS (SELECT w, want_c, got, got_c FROM (SELECT paper_id, name, min(aff) AS w, min(aff % 2) AS want_c FROM gold GROUP BY ALL) FULL JOIN
  (SELECT paper_id, name, min(aff) AS got, min(aff % 2) AS got_c FROM pred GROUP BY ALL) USING (paper_id, name)),
n AS (SELECT count(*) FILTER (w IS NOT NULL AND got IS NOT NULL) AS tp, count(*) FILTER (w IS NULL) AS fp, count(*) FILTER (got IS NULL) AS fn,
  count(*) FILTER (w = got) AS aff_tp, count(*) FILTER (w <> got) AS aff_fp, count(*) FILTER (want_c = got_c) AS country_right, count(*) FILTER (w = got AND want_c = got_c) AS both_right FROM x)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, fp / (tp + fp) AS hallucination_rate, both_right / tp AS hierarchical FROM n"""))
def _(spark, d):
    land = (F.col("aff") % 2).alias("country")
    return m.micro(t.gold(spark, d).select("paper_id", "name", "aff", land), t.predicted(spark, d).select("paper_id", "name", "aff", land))


@query("a23_stage_rates", "SELECT coalesce(event_type, 'overall') AS stage, count(*)::BIGINT AS attempts, count(*) FILTER (event_id % 5 > 0)::BIGINT AS successes, count(*) FILTER (event_id % 5 > 0) / count(*) AS rate FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return m.stage_rates(t.table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 5 > 0).alias("ok")))


@query("a24_outcomes", "SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'full' WHEN o_orderstatus = 'F' THEN 'partial' ELSE 'failed' END AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, d):
    o = t.table(spark, d, "orders")
    return m.outcomes(o.select((F.col("o_orderstatus") == "F").alias("completed"), (F.col("o_orderkey") % 2 == 0).alias("normalised")))


@query("a25_engineering", "SELECT avg(event_id % 900) AS avg_millis, (sum(event_id % 2000)::BIGINT * 0.15::DOUBLE + sum(event_id % 300)::BIGINT * 0.6::DOUBLE) / 1e6::DOUBLE AS cost, count(*)::BIGINT AS calls, count(*) FILTER (user_id % 3 = 0) / count(*) AS cache_hit_rate FROM events")
def _(spark, d):
    e = F.col("event_id")
    return m.engineering(t.table(spark, d, "events").select((e % 900).alias("millis"), (e % 2000).alias("tokens_in"), (e % 300).alias("tokens_out"), (F.col("user_id") % 3 == 0).alias("cached")))


@query("a26_quality_score", """SELECT n_nationkey, round(CASE WHEN n_nationkey % 5 = 0 THEN b / 0.85 ELSE b + 0.15 * least(1, 60 / greatest(n_nationkey * 10, 1)) END, 9) AS score FROM
  (SELECT n_nationkey, 0.6::DOUBLE * CASE WHEN n_nationkey > 3 THEN 0.3::DOUBLE * n_nationkey / 25 + 0.3 * 0.5 + 0.4 * 0.25 ELSE 0 END + 0.25::DOUBLE * 0.5 AS b FROM nation)""")
def _(spark, d):
    k = F.col("n_nationkey")
    score = m.quality_score(F.when(k > 3, k / 25).otherwise(0.0), F.lit(0.5), F.lit(0.25), F.lit(0.5), F.when(k % 5 != 0, k * 10))
    return t.table(spark, d, "nation").select("n_nationkey", F.round(score, 9).alias("score"))


@query("a28_kappa", sql(""", x AS (SELECT a, b, count(*) AS n FROM rating GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS o FROM x),
e AS (SELECT sum(r.x * c.y) AS e FROM (SELECT a, sum(n) AS x FROM x GROUP BY 1) r JOIN (SELECT b, sum(n) AS y FROM x GROUP BY 1) c ON a = b)
SELECT n::BIGINT AS n, round((o / n - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM s, e"""))
def _(spark, d):
    return g.kappa(t.ratings(spark, d))


@query("a28_confusion", sql("SELECT a, b, count(*)::BIGINT AS n FROM rating GROUP BY ALL"))
def _(spark, d):
    return g.confusion(t.ratings(spark, d))


_K = """, x AS (SELECT {s} a, b, count(*) AS n FROM {f} GROUP BY ALL), s AS (SELECT {s} sum(n) AS n, coalesce(sum(n) FILTER (a = b), 0) AS o FROM x GROUP BY ALL),
e AS (SELECT {rs} sum(r.x * c.y) AS e FROM (SELECT {s} a, sum(n) AS x FROM x GROUP BY ALL) r JOIN (SELECT {s} b, sum(n) AS y FROM x GROUP BY ALL) c ON r.a = c.b {j} GROUP BY ALL)
"""


@query("a29_kappa_by_system", sql(_K.format(s="system,", rs="r.system,", f="rating", j="AND r.system = c.system") + "SELECT system, n::BIGINT AS n, round(CASE WHEN abs(1 - coalesce(e, 0) / (n * n)) < 1e-12 THEN 1.0 ELSE (o / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END, 9) AS kappa FROM s LEFT JOIN e USING (system)"))
def _(spark, d):
    return g.kappa(t.ratings(spark, d), ["system"])


def _long(spark, d):
    r = t.ratings(spark, d)
    return r.select("unit", "system", F.lit("a").alias("judge"), F.col("a").alias("score")).union(r.filter("unit % 4 > 0").select("unit", "system", F.lit("b"), "b")).union(
        r.filter("unit % 3 > 0").select("unit", "system", F.lit("c"), F.greatest("a", "b"))
    )


_LONG = ", jj AS (SELECT unit, system, 'a' AS judge, a AS score FROM rating UNION ALL SELECT unit, system, 'b', b FROM rating WHERE unit % 4 > 0 UNION ALL SELECT unit, system, 'c', greatest(a, b) FROM rating WHERE unit % 3 > 0)"


@query("a30_alpha_ordinal", sql(_LONG + """, k AS (SELECT unit, judge, score FROM jj WHERE unit IN (SELECT unit FROM jj GROUP BY 1 HAVING count(*) > 1)),
f AS (SELECT score, count(*) AS n FROM k GROUP BY 1),
d AS (SELECT x.score AS c, y.score AS k, (SELECT sum(n) FROM f WHERE f.score BETWEEN x.score AND y.score) - x.n / 2 - y.n / 2 AS h, x.n AS fx, y.n AS fy FROM f x JOIN f y ON x.score < y.score),
o AS (SELECT sum(CASE WHEN a.score = b.score THEN 0 ELSE (SELECT h * h FROM d WHERE d.c = least(a.score, b.score) AND d.k = greatest(a.score, b.score)) END) / count(*) AS o FROM k a JOIN k b ON a.unit = b.unit AND a.judge < b.judge),
e AS (SELECT sum(2 * fx * fy * h * h) / (SELECT sum(n) * sum(n) FROM f) AS e FROM d) SELECT round(1 - o / e, 9) AS alpha FROM o, e"""))
def _(spark, d):
    return g.alpha_ordinal(_long(spark, d))


@query("a31_alpha_variance", sql(_LONG + """, k AS (SELECT unit, judge, score FROM jj WHERE unit IN (SELECT unit FROM jj GROUP BY 1 HAVING count(*) > 1))
SELECT round(1 - (SELECT avg((a.score - b.score) * (a.score - b.score)) FROM k a JOIN k b ON a.unit = b.unit AND a.judge < b.judge) / (2 * (SELECT var_pop(score) FROM k)), 9) AS alpha"""))
def _(spark, d):
    return g.alpha_variance(_long(spark, d))


@query("a32_bias", sql("SELECT avg(a - b) AS bias, count(*)::BIGINT AS n FROM rating"))
def _(spark, d):
    return g.bias(t.ratings(spark, d))


@query("a33_judge_grid", sql(_LONG + ", pp AS (SELECT x.judge AS j1, y.judge AS j2, x.system, x.score AS a, y.score AS b FROM jj x JOIN jj y ON x.unit = y.unit AND x.judge < y.judge)"
    + _K.format(s="j1, j2, system,", rs="r.j1, r.j2, r.system,", f="pp", j="AND r.system = c.system AND r.j1 = c.j1 AND r.j2 = c.j2")
    + """, r AS (SELECT j1, j2, system, n::BIGINT AS n, (CASE WHEN abs(1 - coalesce(e, 0) / (n * n)) < 1e-12 THEN 1.0 ELSE (o / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END)::DOUBLE AS kappa FROM s LEFT JOIN e USING (j1, j2, system))
SELECT j1, j2, system, n, round(kappa, 9) AS kappa FROM r UNION ALL SELECT j1, j2, 'all', sum(n)::BIGINT, round(avg(kappa), 9) FROM r GROUP BY ALL"""))
def _(spark, d):
    return g.judge_grid(_long(spark, d))


@query("a34_judge_bias", sql(_LONG + """, p AS (SELECT judge, system, avg(score) AS m FROM jj GROUP BY ALL), f AS (SELECT j.judge, s.system, m FROM (SELECT DISTINCT judge FROM jj) j CROSS JOIN (SELECT DISTINCT system FROM jj) s LEFT JOIN p ON p.judge = j.judge AND p.system = s.system)
SELECT judge, system, round(coalesce(m, e) - e, 9) AS bias FROM (SELECT *, avg(coalesce(m, 0)) OVER (PARTITION BY system) AS e FROM f)"""))
def _(spark, d):
    return g.judge_bias(_long(spark, d))


@query("a35_pair_score", sql("""SELECT paper_id, CASE WHEN j < 0.5 THEN 0 WHEN j < 1 THEN 1 ELSE 2 END::INT AS score FROM (SELECT paper_id, count(*) FILTER (s = 2) / count(*) AS j FROM
  (SELECT paper_id, name, aff, count(*) AS s FROM (SELECT paper_id, name, aff FROM gold UNION ALL SELECT paper_id, name, aff FROM pred) GROUP BY ALL) GROUP BY 1)"""))
def _(spark, d):
    return g.pair_score(t.gold(spark, d), t.predicted(spark, d))


@query("f11_both_scored", sql(_LONG + "SELECT x.unit, x.score AS a, y.score AS b FROM jj x JOIN jj y ON x.unit = y.unit AND x.judge = 'a' AND y.judge = 'b'"))
def _(spark, d):
    s = _long(spark, d)
    return s.filter("judge = 'a'").select("unit", F.col("score").alias("a")).join(s.filter("judge = 'b'").select("unit", F.col("score").alias("b")), "unit")


@query("a36_wilson", """SELECT c_mktsegment, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high
  FROM (SELECT c_mktsegment, 1.96::DOUBLE AS z, count(*) AS n, count(*) FILTER (c_acctbal > 0) / count(*) AS p FROM customer GROUP BY 1)""")
def _(spark, d):
    by = t.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("k"), F.count("*").alias("n"))
    low, high = m.wilson(F.col("k"), F.col("n"))
    return by.select("c_mktsegment", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a37_bootstrap")
def _(spark, d):
    s = _scores(spark, d).join(t.papers(spark, d).select("paper_id", "venue_key"), "paper_id")
    return m.bootstrap(s, "venue_key", "f1")


_SYS = ", sys AS (SELECT venue_key AS system, avg(f1) AS f1 FROM scores JOIN paper USING (paper_id) GROUP BY 1)"


def _systems(spark, d):
    return _scores(spark, d).join(t.papers(spark, d).select("paper_id", F.col("venue_key").alias("system")), "paper_id").groupBy("system").agg(F.avg("f1").alias("f1"))


@query("a38_hypotheses", sql(_SCORES + """, gain AS (SELECT venue_key AS system, avg(f1) - 0.2 AS gain, avg(f1) - 0.2 - 1.96 * stddev_pop(f1) / sqrt(count(*)) AS low FROM scores JOIN paper USING (paper_id) GROUP BY 1)
SELECT system, CASE WHEN gain >= 0.01 AND low > 0 THEN 'supported' WHEN gain >= 0.01 THEN 'inconclusive' ELSE 'rejected' END AS verdict, round(gain, 9) AS gain, round(low, 9) AS low FROM gain"""))
def _(spark, d):
    s = _scores(spark, d).join(t.papers(spark, d).select("paper_id", F.col("venue_key").alias("system")), "paper_id")
    by = s.groupBy("system").agg((F.avg("f1") - 0.2).alias("gain"), (F.avg("f1") - 0.2 - 1.96 * F.stddev_pop("f1") / F.sqrt(F.count("*"))).alias("low"))
    return by.select("system", m.hypothesis(F.col("gain"), F.col("low"), 0.01).alias("verdict"), F.round("gain", 9).alias("gain"), F.round("low", 9).alias("low"))


@query("a39_ablation", sql(_SCORES + _SYS + "SELECT system, round(f1 - (SELECT f1 FROM sys WHERE system = '5-low'), 9) AS delta FROM sys"))
def _(spark, d):
    return m.ablation(_systems(spark, d), "5-low").select("system", F.round("delta", 9).alias("delta"))


@query("w02_leaderboard", sql(_SCORES + _SYS + "SELECT system, row_number() OVER (ORDER BY round(f1, 9) DESC, system)::INT AS rank FROM sys"))
def _(spark, d):
    return m.leaderboard(_systems(spark, d).withColumn("f1", F.round("f1", 9))).select("system", "rank")


_CHARGES = "SELECT user_id AS budget, event_id AS seq, event_id % 90 AS cost, event_type AS model FROM events"


def _charges(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("user_id").alias("budget"), F.col("event_id").alias("seq"), (F.col("event_id") % 90).alias("cost"), F.col("event_type").alias("model"), (F.col("event_id") % 700).alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))


@query("w06_running_spend", f"SELECT budget, seq, spent::BIGINT AS spent, spent > 900 AS over FROM (SELECT *, sum(cost) OVER (PARTITION BY budget ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM ({_CHARGES}))")
def _(spark, d):
    return m.spend(_charges(spark, d), 900).select("budget", "seq", "spent", "over")


REPLAY = f"""SELECT budget, x.spent::BIGINT AS spent, x.accepted::BIGINT AS accepted FROM (SELECT budget, list_reduce(list_prepend({{'spent': 0::BIGINT, 'accepted': 0::BIGINT}},
  list_transform(list(cost ORDER BY seq), lambda c: {{'spent': c::BIGINT, 'accepted': 1::BIGINT}})), lambda a, b: CASE WHEN a.spent + b.spent <= 900 THEN {{'spent': a.spent + b.spent, 'accepted': a.accepted + 1}} ELSE a END) AS x FROM ({_CHARGES}) GROUP BY 1)"""


@query("x10_budget_replay", REPLAY)
def _(spark, d):
    return m.replay(_charges(spark, d), 900)


@query("a40_ledger", "SELECT cost, calls, 1e9::DOUBLE - cost AS remaining FROM (SELECT (sum(CASE event_type WHEN 'click' THEN 2 ELSE 1 END * (event_id % 700) + CASE event_type WHEN 'click' THEN 4 ELSE 3 END * (event_id % 50)))::DOUBLE AS cost, count(*)::BIGINT AS calls FROM events)")
def _(spark, d):
    prices = spark.createDataFrame([("click", 2.0, 4.0)], "model string, price_in double, price_out double")
    return m.ledger(_charges(spark, d), prices, (1.0, 3.0), 1e9)


@query("a41_calls_left", "SELECT c_custkey, floor((c_custkey * 10) / (c_custkey % 7 + 1))::BIGINT AS calls FROM customer")
def _(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", m.calls_left(F.col("c_custkey") * 10, F.col("c_custkey") % 7 + 1).alias("calls"))


@query("a42_annotation_status", sql("""SELECT year, count(*) FILTER (a AND b)::BIGINT AS done, count(*) FILTER (a <> b)::BIGINT AS partial, count(*) FILTER (NOT a AND NOT b)::BIGINT AS missing
  FROM (SELECT year, paper_id IN (SELECT paper_id FROM gold) AS a, paper_id IN (SELECT paper_id FROM pred) AS b FROM paper) GROUP BY 1"""))
def _(spark, d):
    return m.annotation_status(t.papers(spark, d), t.gold(spark, d), t.predicted(spark, d))
