"""Affiliation analytics over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.operators import analytics as a
from scholium.plans.catalog import query
from scholium.sources import testdata as t
from scholium.sources.testdata import sql


@query("a01_summary", sql("""SELECT count(DISTINCT paper_id)::BIGINT AS papers, count(DISTINCT name)::BIGINT AS authors, count(DISTINCT inst_name)::BIGINT AS organisations,
  count(DISTINCT country)::BIGINT AS countries, count(*)::BIGINT AS n_rows, count(*) / count(DISTINCT paper_id) AS rows_per_paper FROM flat"""))
def _(spark, d):
    return a.summary(t.flat_rows(spark, d))


@query("a02_top_organisations", sql("""SELECT inst_name, count(name)::BIGINT AS n, min(country) AS country, min(org_type) AS org_type FROM flat GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""))
def _(spark, d):
    return a.top_organisations(t.flat_rows(spark, d), 10)


@query("a03_country_distribution", sql("SELECT country, count(*)::BIGINT AS n, count(DISTINCT inst_name)::BIGINT AS organisations FROM flat GROUP BY 1"))
def _(spark, d):
    return a.country_distribution(t.flat_rows(spark, d))


@query("a04_org_types", sql("SELECT org_type, count(*)::BIGINT AS n FROM flat GROUP BY 1"))
def _(spark, d):
    return a.value_counts(t.flat_rows(spark, d), "org_type")


@query("a05_value_counts", sql("SELECT inst_name, count(*)::BIGINT AS n FROM flat GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"))
def _(spark, d):
    return a.value_counts(t.flat_rows(spark, d), "inst_name", 20)


@query("a06_percent_of_total", sql("SELECT country, count(*)::BIGINT AS n, 100 * count(*) / (SELECT count(*) FROM flat) AS percent FROM flat GROUP BY 1"))
def _(spark, d):
    return a.percent_of_total(t.flat_rows(spark, d), "country")


@query("a07_sectors", sql("""SELECT CASE org_type WHEN 'company' THEN 'industry' WHEN 'education' THEN 'academia' ELSE 'other' END AS sector, count(*)::BIGINT AS n,
  100 * count(*) / (SELECT count(*) FROM flat) AS percent FROM flat GROUP BY 1"""))
def _(spark, d):
    return a.sectors(t.flat_rows(spark, d))


@query("f06_sector_of_type", sql("SELECT inst_id, CASE org_type WHEN 'company' THEN 'industry' WHEN 'education' THEN 'academia' ELSE 'other' END AS sector FROM inst"))
def _(spark, d):
    return t.institutions(spark, d).select("inst_id", a.sector(F.col("org_type")).alias("sector"))


@query("f07_small_slices", sql("""SELECT CASE WHEN n < 0.06 * total THEN 'Other' ELSE inst_name END AS inst_name, sum(n)::BIGINT AS n
  FROM (SELECT *, sum(n) OVER () AS total FROM (SELECT inst_name, count(*) AS n FROM flat GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)) GROUP BY 1"""))
def _(spark, d):
    return a.with_other(a.value_counts(t.flat_rows(spark, d), "inst_name"), "inst_name", 15, 0.06)


@query("q25_papers_by_date", sql("SELECT published, count(*)::BIGINT AS papers FROM paper GROUP BY 1"))
def _(spark, d):
    return a.papers_by_date(t.papers(spark, d))


@query("a27_dataset_stats", sql("""SELECT count(DISTINCT paper_id)::BIGINT AS papers, count(*)::BIGINT AS authors, count(DISTINCT name)::BIGINT AS names,
  count(DISTINCT aff)::BIGINT AS affiliations, count(*) / count(DISTINCT paper_id) AS authors_per_paper FROM gold"""))
def _(spark, d):
    return a.dataset_stats(t.gold(spark, d))


def _nested(spark, d):
    author = F.struct(F.col("name"), F.when(F.col("org_type") != "facility", F.col("org_type")).alias("org_type"), "author_id")
    return t.flat_rows(spark, d).join(t.papers(spark, d).select("paper_id", "title", "venue_key"), "paper_id").groupBy("paper_id", "title").agg(
        F.array_sort(F.collect_set("venue_key")).alias("categories"),
        F.array_sort(F.collect_list(F.struct("author_id", author.alias("x")))).alias("listed"),
    ).select("paper_id", "title", "categories", F.transform("listed", lambda x: x["x"]).alias("authors"))


_FLAT = """SELECT paper_id, title, venue_key AS categories, (row_number() OVER (PARTITION BY paper_id ORDER BY author_id) - 1)::INT AS pos, name,
  CASE WHEN org_type = 'facility' THEN 'unknown' ELSE org_type END AS org_type FROM flat JOIN paper USING (paper_id)"""


@query("s02_flatten_papers", sql(_FLAT))
def _(spark, d):
    return a.flatten_papers(_nested(spark, d))


@query("s03_nest_rows", sql(f"SELECT paper_id, any_value(title) AS title, string_agg(name, '|' ORDER BY pos) AS names FROM ({_FLAT}) GROUP BY 1"))
def _(spark, d):
    return a.nest_rows(a.flatten_papers(_nested(spark, d))).select("paper_id", "title", F.array_join(F.transform("authors", lambda x: x["name"]), "|").alias("names"))


@query("f16_result_projection", """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS abstract, coalesce(lang, 'unknown') AS lang FROM documents""")
def _(spark, d):
    from scholium.functions.text import cut

    return t.table(spark, d, "documents").select("doc_id", cut("text", 500, "...").alias("abstract"), F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("f15_truncation", "SELECT doc_id, left(text, 2000) AS abstract, left(text, 8000) AS raw FROM documents")
def _(spark, d):
    from scholium.functions.text import cut

    return t.table(spark, d, "documents").select("doc_id", cut("text", 2000).alias("abstract"), cut("text", 8000).alias("raw"))


def _tasks(spark, d):
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("started_at"), "user_id", "value",
    )


@query("f09_task_page", """SELECT event_id AS task_id, user_id FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN ts END AS s FROM events WHERE event_type = 'click')
  ORDER BY s DESC NULLS LAST, event_id LIMIT 25 OFFSET 10""")
def _(spark, d):
    return a.page(_tasks(spark, d), "click", 10, 25).select("task_id", "user_id")


@query("f08_status", "SELECT event_type AS status, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'purchase')::BIGINT AS completed FROM events GROUP BY 1")
def _(spark, d):
    done = F.col("status") == "purchase"
    return _tasks(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"))


@query("a47_progress", """SELECT user_id AS task, count(*)::BIGINT AS done, least(90.0, count(*) / 150 * 90) AS percent,
  sum(event_id % 1000) / count(*) * greatest(150 - count(*), 0) AS eta FROM events GROUP BY 1""")
def _(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").alias("task"), (F.col("event_id") % 1000).alias("millis"))
    return a.progress(e, 150)


@query("a52_request_counters", "SELECT coalesce(event_type, 'all') AS source, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return a.requests(t.table(spark, d, "events").select(F.col("event_type").alias("source")))


@query("a44_span_counts", "SELECT lang AS parser, source AS region, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return t.table(spark, d, "documents").groupBy(F.col("lang").alias("parser"), F.col("source").alias("region")).agg(F.count("*").alias("n"))


@query("t01_top_sorted", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def _(spark, d):
    return t.table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(7)


@query("t06_hinted_order", """SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY (s_nationkey = 3) DESC, s_acctbal DESC, s_suppkey)::INT AS place FROM supplier""")
def _(spark, d):
    from scholium.operators.resolve import hinted_order

    s = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("country"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 4).alias("q"))
    return hinted_order(s, 3, "s_suppkey", "q").select("s_suppkey", "place")


@query("u01_set_operations", sql("""SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT paper_id, name, aff FROM gold INTERSECT SELECT paper_id, name, aff FROM pred)
UNION ALL SELECT 'either', count(*) FROM (SELECT paper_id, name, aff FROM gold UNION SELECT paper_id, name, aff FROM pred)
UNION ALL SELECT 'missed', count(*) FROM (SELECT paper_id, name, aff FROM gold EXCEPT SELECT paper_id, name, aff FROM pred)"""))
def _(spark, d):
    g, p = t.gold(spark, d), t.predicted(spark, d).drop("confidence")
    parts = {"both": g.intersect(p), "either": g.union(p).distinct(), "missed": g.subtract(p)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@query("u02_rejected", sql("SELECT paper_id, name FROM pred WHERE name NOT IN (SELECT name FROM gold WHERE gold.paper_id = pred.paper_id)"))
def _(spark, d):
    return t.predicted(spark, d).select("paper_id", "name").join(t.gold(spark, d).select("paper_id", "name"), ["paper_id", "name"], "left_anti")


@query("u03_union_specialists", "SELECT event_type AS specialist, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(spark, d):
    from scholium.operators.resolve import union_specialists

    e = t.specialists(spark, d)
    kinds = [r[0] for r in e.select("specialist").distinct().collect()]  # a handful of extractors
    parts = {k: e.filter(F.col("specialist") == k).select("seq", "name") for k in kinds}
    return union_specialists(parts).groupBy("specialist").agg(F.count("*").alias("n"))


@query("u04_edge_union", sql("SELECT DISTINCT a, b FROM collab WHERE year IN (1995, 1996)"))
def _(spark, d):
    from scholium.operators.graph import collaborations

    c = collaborations(t.affiliated(spark, d))
    return c.filter("year = 1995").select("a", "b").union(c.filter("year = 1996").select("a", "b")).distinct()


@query("u07_ordered_dedupe", "SELECT event_type AS v, row_number() OVER (ORDER BY min(event_id))::INT AS place FROM events GROUP BY 1")
def _(spark, d):
    from scholium.operators.resolve import ordered_distinct

    return ordered_distinct(t.table(spark, d, "events").select(F.col("event_type").alias("v"), F.col("event_id").alias("pos")), "v", "pos")
