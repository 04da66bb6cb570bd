"""Keyed state and streaming over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.operators import state as s
from scholium.plans.catalog import query
from scholium.sources import sinks, testdata as t
from scholium.sources.scratch import scratch


def _cache(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("event_type").alias("namespace"), (F.col("user_id") % 20).alias("key"), F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("value"), F.col("ts").alias("expires_at"), "event_id")


_C = "c AS (SELECT event_type AS namespace, user_id % 20 AS key, arg_max(CASE WHEN event_id % 6 <> 0 THEN event_id ELSE -1 END, event_id) AS value, arg_max(ts, event_id) AS expires_at FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 10 DAY AS now FROM events)"


def _latest(spark, d):
    return s.upsert(_cache(spark, d), ["namespace", "key"], "event_id").drop("event_id")


def _now(spark, d):
    return t.table(spark, d, "events").agg((F.max("ts") - F.expr("interval 10 days")).alias("now")).first()[0]


@query("k04_cache_upsert", f"WITH {_C} SELECT namespace, key, nullif(value, -1) AS value, expires_at FROM c")
def _(spark, d):
    return _latest(spark, d)


@query("x01_live_entries", f"WITH {_C} SELECT namespace, key, nullif(value, -1) AS value FROM c, m WHERE expires_at > now")
def _(spark, d):
    return s.live(_latest(spark, d), _now(spark, d)).select("namespace", "key", "value")


@query("x02_read_through", f"WITH {_C}, w AS (SELECT DISTINCT namespace, k AS key FROM c, range(25) r(k)) SELECT CASE WHEN c.key IS NULL THEN 'miss' WHEN value = -1 THEN 'known absent' ELSE 'hit' END AS outcome, count(*)::BIGINT AS n FROM w LEFT JOIN (SELECT c.* FROM c, m WHERE expires_at > now) c USING (namespace, key) GROUP BY 1")
def _(spark, d):
    latest = _latest(spark, d)
    wanted = latest.select("namespace").distinct().join(spark.range(25).select(F.col("id").alias("key")))
    hits, misses = s.read_through(wanted, latest, _now(spark, d), ["namespace", "key"])
    outcome = F.when(F.col("value").isNull(), "known absent").otherwise("hit")
    return hits.select(outcome.alias("outcome")).union(misses.select(F.lit("miss"))).groupBy("outcome").agg(F.count("*").alias("n"))


def _facts(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("event_type").alias("venue"), F.when(F.col("event_id") % 3 != 0, (1990 + F.col("user_id") % 4)).alias("year"), F.col("event_id").alias("seq"), (F.col("event_id") % 40).alias("paper_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("summary"))


_F = "f AS (SELECT event_type AS venue, CASE WHEN event_id % 3 <> 0 THEN 1990 + user_id % 4 END AS year, event_id AS seq, event_id % 40 AS paper_id FROM events), mem AS (SELECT venue, year, count(*)::BIGINT AS papers, max(q) AS updated FROM (SELECT venue, year, paper_id, min(seq) AS q FROM f GROUP BY ALL) GROUP BY ALL)"


@query("x03_fold_memory", f"WITH {_F} SELECT venue, year, papers, 's' || updated AS summary, updated FROM mem")
def _(spark, d):
    f = _facts(spark, d)
    return s.fold_memory(f.union(f), ["venue", "year"])


@query("x04_recall", f"WITH {_F}, w AS (SELECT DISTINCT venue, y AS year FROM mem, range(1990, 1996) r(y)) SELECT w.venue, w.year, 's' || max(updated) AS summary FROM w JOIN mem ON w.venue = mem.venue AND (mem.year IS NULL OR mem.year = w.year) GROUP BY ALL")
def _(spark, d):
    m = s.fold_memory(_facts(spark, d), ["venue", "year"])
    wanted = m.select("venue").distinct().join(spark.range(1990, 1996).select(F.col("id").alias("year")))
    return s.recall(m, wanted)


@query("t07_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return s.upsert(t.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("k05_memory_upsert", f"WITH {_F} SELECT venue, year, max(seq) AS seq FROM f GROUP BY ALL")
def _(spark, d):
    f = _facts(spark, d).select("venue", "year", "seq")
    return sinks.upsert_table(f.filter("seq % 2 = 0"), f.filter("seq % 2 = 1"), ["venue", "year"], "seq")


@query("x05_memory_text", "SELECT n_name AS venue, n_nationkey AS year, CASE WHEN n_nationkey % 2 = 0 THEN '[' || n_name || ' ' || n_nationkey || '] Critic rejected 1 candidate(s): B. Prefer multi-specialist agreement for confidence.' ELSE '[' || n_name || ' ' || n_nationkey || '] ' END AS summary FROM nation")
def _(spark, d):
    n = t.table(spark, d, "nation")
    both = F.array(F.lit("A"), F.lit("B"))
    return s.memory_text(n.select(F.col("n_name").alias("venue"), F.col("n_nationkey").alias("year"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("A"))).otherwise(both).alias("accepted"), both.alias("baseline")))


@query("q28_terminal_status", "SELECT user_id AS task, coalesce(arg_min(event_type, event_id) FILTER (event_type = 'purchase'), arg_max(event_type, event_id)) AS status FROM events GROUP BY 1")
def _(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return s.terminal_status(e, ["purchase"])


@query("x11_reduce_state", "SELECT user_id AS task, arg_max(event_id, event_id) FILTER (event_id % 3 > 0) AS papers, string_agg(event_type, ',' ORDER BY event_id) FILTER (event_id % 5 = 0) AS logs FROM events GROUP BY 1")
def _(spark, d):
    e = t.table(spark, d, "events")
    none = F.array().cast("array<bigint>")
    u = e.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.array("event_id")).otherwise(none).alias("papers"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("log"))
    r = s.reduce_state(u)
    return r.select("task", F.get("papers", F.lit(0)).alias("papers"), F.nullif(F.array_join("logs", ","), F.lit("")).alias("logs"))


@query("a50_merge_maps", "SELECT user_id AS task, event_type AS name, max(event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    e = t.table(spark, d, "events")
    return s.merge_maps(e.select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), F.create_map("event_type", "event_id").alias("entries")))


@query("k09_budget_totals", "SELECT user_id AS budget, sum(event_id % 90)::BIGINT AS total, count(*)::BIGINT AS calls, count(*)::INT AS n_records FROM events GROUP BY 1")
def _(spark, d):
    e = t.table(spark, d, "events")
    c = e.select(F.col("user_id").alias("budget"), F.col("event_id").alias("seq"), F.col("event_type").alias("model"), (F.col("event_id") % 90).alias("cost"))
    folder = scratch(spark, "budgets")
    sinks.write_checkpoint(c, folder)
    records = spark.read.schema("seq long, budget long").json(f"{folder}/records").groupBy("budget").agg(F.count("*").cast("int").alias("n_records"))
    return spark.read.schema("budget long, total long, calls long").json(f"{folder}/totals").join(records, "budget")


@query("x07_windowed_progress", "SELECT event_type, date_trunc('day', ts) AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(spark, d):
    from scholium.streaming.progress import windowed_progress

    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_progress(e).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("x07_sessions", """SELECT user_id, count(*)::BIGINT AS n_sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, k, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    from scholium.streaming.progress import sessions

    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))

