"""Graph queries over the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scholium.operators import forecast, graph, graphcells
from scholium.plans.catalog import query
from scholium.sources import testdata as t
from scholium.sources.scratch import cut, enough_partitions
from scholium.sources.testdata import sql

_SHARE = """SELECT venue_key, year, sum(n)::BIGINT AS total, sum(CASE WHEN org_type = 'company' THEN n ELSE 0 END)::BIGINT AS industry,
  sum(CASE WHEN org_type = 'company' THEN n ELSE 0 END)::BIGINT / sum(n)::BIGINT AS share"""


def _parts(spark, d):
    return t.affiliated(spark, d), t.authored(spark, d), t.papers(spark, d), t.institutions(spark, d)


@query("g01_upsert_nodes", """WITH f AS (SELECT s_suppkey AS author_id, s_name AS name, NULL::INT AS inst_id, 1 AS ingest_seq FROM supplier
  UNION ALL SELECT s_suppkey, NULL, s_nationkey, 2 FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT s_suppkey, 'renamed', NULL, 3 FROM supplier WHERE s_suppkey % 5 = 0)
SELECT author_id, arg_max(name, ingest_seq) FILTER (name IS NOT NULL) AS name, arg_max(inst_id, ingest_seq) FILTER (inst_id IS NOT NULL) AS inst_id,
  max(ingest_seq) AS ingest_seq FROM f GROUP BY 1""")
def _(spark, d):
    a = t.authors(spark, d)
    one = a.select("author_id", "name", F.lit(1).alias("ingest_seq"))
    two = a.filter("author_id % 2 = 0").select("author_id", "inst_id", F.lit(2).alias("ingest_seq"))
    three = a.filter("author_id % 5 = 0").select("author_id", F.lit("renamed").alias("name"), F.lit(3).alias("ingest_seq"))
    return graph.upsert_nodes(graph.upsert_nodes(one, two, "author_id"), three, "author_id").select("author_id", "name", "inst_id", "ingest_seq")


@query("g02_upsert_edges", sql("SELECT DISTINCT author_id, paper_id, position FROM authored WHERE author_id % 3 <> 0"))
def _(spark, d):
    e = t.authored(spark, d)
    nodes = t.authors(spark, d).filter("author_id % 3 <> 0")
    return graph.upsert_edges(e, e, [("author_id", nodes, "author_id"), ("paper_id", t.papers(spark, d), "paper_id")]).select("author_id", "paper_id", "position")


@query("g03_coauthors", sql("SELECT a, b, paper_id, year FROM coauth"))
def _(spark, d):
    return graph.coauthors(t.authored(spark, d), t.papers(spark, d))


@query("g04_collaborations", sql("SELECT a, b, year, papers_count FROM collab"))
def _(spark, d):
    return graph.collaborations(t.affiliated(spark, d))


@query("g05_industry_share", sql(_SHARE + """ FROM (SELECT venue_key, p.year, org_type, count(*) AS n
  FROM affil JOIN paper p USING (paper_id) JOIN inst USING (inst_id) GROUP BY ALL) GROUP BY ALL"""))
def _(spark, d):
    return graph.industry_share(*_parts(spark, d))


_FAN = """, ee AS (SELECT author_id, inst_id, count(*) AS e FROM affil GROUP BY ALL),
mm AS (SELECT author_id, venue_key, paper.year, count(*) AS m FROM authored JOIN paper USING (paper_id) GROUP BY ALL)
"""


@query("g05_industry_share_reference", sql(_FAN + _SHARE + " FROM (SELECT *, e * m AS n FROM ee JOIN mm USING (author_id) JOIN inst USING (inst_id)) GROUP BY ALL"))
def _(spark, d):
    return graph.industry_share(*_parts(spark, d), mode="reference")


_RANK = " SELECT rank, inst_id, inst_name, country, org_type, papers FROM (SELECT *, row_number() OVER (ORDER BY papers DESC, inst_id)::INT AS rank FROM (SELECT inst_id, {n}::BIGINT AS papers FROM {f} GROUP BY 1) ORDER BY rank LIMIT {k}) JOIN inst USING (inst_id)"


@query("g06_top_institutions", sql(_RANK.format(n="count(*)", f="affil JOIN paper p USING (paper_id) WHERE contains(venue_key, 'urgent')", k=20)))
def _(spark, d):
    return graph.top_institutions(*_parts(spark, d), venue="URGENT")


@query("g06_top_institutions_reference", sql(_FAN + _RANK.format(n="sum(e * m)", f="ee JOIN mm USING (author_id) WHERE contains(venue_key, 'urgent') AND year = 1995", k=5)))
def _(spark, d):
    return graph.top_institutions(*_parts(spark, d), venue="urgent", year=1995, top_k=5, mode="reference")


@query("g07_country_heatmap", sql("""SELECT x.country AS country_a, y.country AS country_b, year, sum(papers_count)::BIGINT AS papers
  FROM collab JOIN inst x ON a = x.inst_id JOIN inst y ON b = y.inst_id WHERE papers_count >= 2 AND x.country < y.country GROUP BY ALL"""))
def _(spark, d):
    return graph.country_heatmap(graph.collaborations(t.affiliated(spark, d)), t.institutions(spark, d), min_papers=2)


@query("g07_country_papers", sql("""SELECT x.country AS country_a, y.country AS country_b, x.year, count(DISTINCT x.paper_id)::BIGINT AS papers
  FROM flat x JOIN flat y ON x.paper_id = y.paper_id AND x.country < y.country GROUP BY ALL"""))
def _(spark, d):
    return graph.country_papers(t.affiliated(spark, d), t.institutions(spark, d))


@query("g08_neighborhood", sql(""", lastp AS (SELECT a, b, max(year) AS year FROM coauth GROUP BY ALL),
h1 AS (SELECT b AS author_id, a AS via, row_number() OVER (ORDER BY year DESC, b) AS place FROM lastp WHERE a = 7 QUALIFY place <= 30),
q AS (SELECT greatest(1, (30 - count(*)) // greatest(least(count(*), 10), 1)) AS quota FROM h1),
c AS (SELECT l.b AS author_id, l.a AS via, place, row_number() OVER (PARTITION BY l.a ORDER BY l.year DESC, l.b) AS turn
  FROM lastp l JOIN h1 ON l.a = h1.author_id WHERE place <= 10 AND l.b <> 7 AND l.b NOT IN (SELECT author_id FROM h1))
SELECT 0 AS hop, 7::BIGINT AS author_id, NULL::BIGINT AS via UNION ALL SELECT 1, author_id, via FROM h1
UNION ALL SELECT 2, author_id, arg_min(via, place) FROM c, q WHERE turn <= quota GROUP BY author_id"""))
def _(spark, d):
    return graph.neighborhood(graph.coauthors(t.authored(spark, d), t.papers(spark, d)), F.lit(7), max_nodes=30)


_EDGES_SQL = """, ed AS (SELECT 'Author' AS sk, author_id AS s, 'Paper' AS dk, paper_id AS x FROM authored UNION ALL
  SELECT 'Author', author_id, 'Institution', inst_id::BIGINT FROM author UNION ALL SELECT 'Paper', paper_id, 'Author', author_id FROM authored UNION ALL
  SELECT 'Institution', inst_id::BIGINT, 'Author', author_id FROM author),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sk, s, dk ORDER BY x) AS turn FROM ed)
  WHERE turn <= CASE sk || '>' || dk WHEN 'Author>Paper' THEN 5 WHEN 'Author>Institution' THEN 5 WHEN 'Paper>Author' THEN 10 ELSE 0 END),
f1 AS (SELECT DISTINCT dk AS kind, x AS id FROM w WHERE sk = 'Author' AND s = 3),
f2 AS (SELECT DISTINCT w.dk AS kind, w.x AS id FROM w JOIN f1 ON w.sk = f1.kind AND w.s = f1.id
  EXCEPT (SELECT kind, id FROM f1 UNION ALL SELECT 'Author', 3))
SELECT * FROM (SELECT 0 AS hop, 'Author' AS kind, 3::BIGINT AS id UNION ALL SELECT 1, kind, id FROM f1 UNION ALL SELECT 2, kind, id FROM f2) ORDER BY hop, kind, id LIMIT 80"""


@query("g10_subgraph", sql(_EDGES_SQL))
def _(spark, d):
    w, a = t.authored(spark, d), t.authors(spark, d)

    def edge(df, sk, s, dk, x):
        return df.select(F.lit(sk).alias("src_kind"), F.col(s).cast("long").alias("src"), F.lit(dk).alias("dst_kind"), F.col(x).cast("long").alias("dst"), F.col(x).cast("long").alias("ord"))

    edges = edge(w, "Author", "author_id", "Paper", "paper_id").union(edge(a, "Author", "author_id", "Institution", "inst_id"))
    edges = edges.union(edge(w, "Paper", "paper_id", "Author", "author_id")).union(edge(a, "Institution", "inst_id", "Author", "author_id"))
    seeds = spark.range(3, 4).select(F.lit("Author").alias("kind"), "id")
    return graph.subgraph(edges, seeds, {("Author", "Paper"): 5, ("Author", "Institution"): 5, ("Paper", "Author"): 10})


@query("g11_descriptions", sql("""SELECT 'Paper | title=' || title || ' year=' || year || ' venue=' || venue_key AS line FROM paper
UNION ALL SELECT 'Institution | name=' || inst_name || ' type=' || org_type || ' country=' || country FROM inst"""))
def _(spark, d):
    return t.papers(spark, d).select(graph.describe("Paper").alias("line")).union(t.institutions(spark, d).select(graph.describe("Institution")))


@query("g12_snapshots", sql(""", y AS (SELECT DISTINCT year FROM paper)
SELECT y.year, (SELECT count(*) FROM coauth c WHERE c.year <= y.year)::BIGINT AS coauthor_edges,
  (SELECT count(*) FROM (SELECT DISTINCT author_id, inst_id FROM affil f WHERE f.year <= y.year))::BIGINT AS affiliation_edges,
  (SELECT count(*) FROM (SELECT DISTINCT a, b FROM collab c WHERE c.year <= y.year))::BIGINT AS collaboration_edges,
  (SELECT count(DISTINCT author_id) FROM affil f WHERE f.year <= y.year)::BIGINT AS authors FROM y"""))
def _(spark, d):
    affil = t.affiliated(spark, d)
    return forecast.snapshots(affil, graph.coauthors(t.authored(spark, d), t.papers(spark, d)), graph.collaborations(affil))


@query("g13_link_targets", sql(""", e AS (SELECT DISTINCT a.author_id AS a, b.author_id AS b, p.year FROM authored a JOIN authored b ON a.paper_id = b.paper_id AND a.author_id < b.author_id JOIN paper p ON p.paper_id = a.paper_id),
first AS (SELECT a, b, min(year) AS year FROM e GROUP BY ALL),
since AS (SELECT id, min(year) AS year FROM (SELECT a AS id, year FROM e UNION ALL SELECT b, year FROM e) GROUP BY 1)
SELECT (first.year - 1)::INT AS year, a, b, 1 AS label FROM first JOIN since x ON a = x.id JOIN since y ON b = y.id WHERE x.year < first.year AND y.year < first.year"""))
def _(spark, d):
    edges = graph.coauthors(t.authored(spark, d), t.papers(spark, d)).filter("a < b").select("a", "b", "year").distinct()
    return forecast.positives(edges)


#: Parts that stand in one order are linked in its year: a sparse graph, unlike those of suppliers and nations.
_PARTS = """line AS (SELECT DISTINCT l_orderkey, l_partkey, year(o_orderdate)::INT AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b, x.year FROM line x JOIN line y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)"""


def _part_edges(spark, d):
    years = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    line = t.lines(spark, d).select("l_orderkey", "l_partkey").distinct().join(years, "l_orderkey")
    pairs = line.select("l_orderkey", "year", F.col("l_partkey").alias("a")).join(line.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey")
    # two pairs of a line or so; what groups them by both ends next needs no other shuffle
    return pairs.filter("a < b").select("a", "b", "year").repartition(enough_partitions(t.table(spark, d, "lineitem"), 2), "a", "b").distinct()


@query("g13_negatives", f"""WITH {_PARTS}, yy AS (SELECT DISTINCT year FROM e), first AS (SELECT a, b, min(year) AS first FROM e GROUP BY ALL),
n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part), s AS (SELECT count(*) AS n FROM part),
h AS (SELECT year, k, md5('0:' || year || ':' || k) AS h FROM yy, range(8000) AS r(k)),
d AS (SELECT year, k, ('0x' || h[1:12])::BIGINT % n AS i, ('0x' || h[13:24])::BIGINT % (n - 1) AS j FROM h, s),
p AS (SELECT year, least(i, j + (j >= i)::INT) AS u, greatest(i, j + (j >= i)::INT) AS v, min(k) AS k FROM d GROUP BY ALL),
o AS (SELECT year, x.id AS a, y.id AS b, p.k FROM p JOIN n x ON x.k = u JOIN n y ON y.k = v LEFT JOIN first ON first.a = x.id AND first.b = y.id WHERE first IS NULL OR first.first > year + 1)
SELECT year, a, b, 0 AS label FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY k) AS turn FROM o) WHERE turn <= 1000""")
def _(spark, d):
    nodes = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return forecast.negatives(_part_edges(spark, d), nodes, 1000)


@query("g14_cofrequency", sql("""SELECT a, b, n / max(n) OVER () AS score FROM (SELECT a, b, sum(papers_count)::BIGINT AS n FROM collab WHERE a < b GROUP BY ALL)"""))
def _(spark, d):
    return forecast.cofrequency(graph.collaborations(t.affiliated(spark, d)).filter("a < b"))


@query("g15_link_features", sql(""", e AS (SELECT DISTINCT a, b FROM collab), deg AS (SELECT a AS id, count(*) AS k FROM e GROUP BY 1)
SELECT x.a AS a, y.a AS b, count(*)::BIGINT AS common, round(sum(1 / ln(1 + k)), 6) AS adamic
FROM e x JOIN e y ON x.b = y.b AND x.a < y.a JOIN deg ON deg.id = x.b GROUP BY ALL"""))
def _(spark, d):
    return forecast.link_features(graph.collaborations(t.affiliated(spark, d)).select("a", "b").distinct())


@query("g15_graph_network")
def _(spark, d):
    """Scores of the last year's new links and as many other pairs of parts, by a network trained on the years before."""
    # snapshots and links ask for the first year of an edge only
    edges = cut(forecast.first_years(_part_edges(spark, d)), "part-edges")
    both = edges.union(edges.select("b", "a", "year"))
    kinds = [F.when(F.col("p_type") == k, 1.0).otherwise(0.0) for k in ("ECONOMY", "PROMO", "SMALL", "STANDARD", "LARGE", "MEDIUM")]
    nodes = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(*kinds, F.col("p_size") / 50).alias("x"))
    targets = cut(forecast.new_links(edges), "part-links")
    links = {r["year"]: r["count"] for r in targets.groupBy("year").count().collect()}  # a few years
    if not links:
        return spark.createDataFrame([], "a long, b long, label int, score double")
    others = forecast.unlinked(edges, nodes.select("id"), links)
    pairs, last = cut(targets.union(others), "part-pairs"), max(links)
    cells = graphcells.Cells(nodes, both, list(links), 7, steps=2)
    net, _losses = cells.train(pairs.filter(F.col("year") < last), hidden=8, epochs=4, rate=0.05)
    return cells.scores(net, pairs.filter(F.col("year") == last)).withColumn("score", F.round("score", 6))


@query("g16_institution_subgraph", sql("""SELECT a, b, sum(papers_count)::BIGINT AS papers FROM collab WHERE year = 1996 AND a < b AND a IN
  (SELECT inst_id FROM affil JOIN paper p USING (paper_id) WHERE contains(venue_key, 'high') AND p.year = 1996) GROUP BY ALL"""))
def _(spark, d):
    affil = t.affiliated(spark, d)
    there = affil.join(t.papers(spark, d).filter("contains(venue_key, 'high') and year = 1996").select("paper_id"), "paper_id")
    edges = graph.collaborations(affil).filter("year = 1996 and a < b")
    return edges.join(there.select(F.col("inst_id").alias("a")).distinct(), "a", "left_semi").groupBy("a", "b").agg(F.sum("papers_count").alias("papers"))


@query("a45_ranking_quality", """WITH x AS (SELECT quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM x),
n AS (SELECT sum(y) AS p, count(*) - sum(y) AS q FROM x),
t AS (SELECT score, sum(y) AS py, count(*) AS c FROM x GROUP BY 1),
cu AS (SELECT py, sum(py) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS k FROM t)
SELECT round(((SELECT sum(rk) FROM r WHERE y = 1) - p * (p + 1) / 2) / (p * q), 9) AS auc, round((SELECT sum(py * tp / k) FROM cu) / p, 9) AS average_precision FROM n""")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return forecast.ranking_quality(t.table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), "score"))


@query("a46_industry_strata", sql("""SELECT year, CASE WHEN r = 0 THEN 'none' WHEN r <= 0.5 THEN 'minority' ELSE 'majority' END AS stratum, count(*)::BIGINT AS papers
  FROM (SELECT paper_id, year, avg(CASE WHEN org_type = 'company' THEN 1.0 ELSE 0.0 END) AS r FROM flat GROUP BY ALL) GROUP BY ALL"""))
def _(spark, d):
    return forecast.industry_strata(t.flat_rows(spark, d))


@query("a48_neighbour_mean", sql(""", e AS (SELECT DISTINCT a, b FROM collab), v AS (SELECT inst_id AS id, count(*)::DOUBLE AS x FROM author GROUP BY 1)
SELECT v.id, v.x + coalesce(s, 0) / greatest(coalesce(k, 0), 1) AS mixed FROM v LEFT JOIN (SELECT b, sum(x) AS s, count(*) AS k FROM e JOIN v ON e.a = v.id GROUP BY 1) ON b = v.id"""))
def _(spark, d):
    nodes = t.authors(spark, d).groupBy(F.col("inst_id").alias("id")).agg(F.count("*").cast("double").alias("x"))
    edges = graph.collaborations(t.affiliated(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return forecast.neighbour_mean(nodes, edges)


@query("a49_scatter_softmax", sql("""SELECT a, b, year, round(exp((papers_count - m) / 10.0) / (sum(exp((papers_count - m) / 10.0)) OVER (PARTITION BY b) + 1e-9), 9) AS weight
  FROM (SELECT *, max(papers_count) OVER (PARTITION BY b) AS m FROM collab)"""))
def _(spark, d):
    edges = graph.collaborations(t.affiliated(spark, d)).withColumn("score", F.col("papers_count") / 10.0)
    return forecast.scatter_softmax(edges, "b", "score").select("a", "b", "year", F.round("weight", 9).alias("weight"))


@query("w10_next_year", sql("""SELECT a, b, year, papers_count, lead(papers_count) OVER (PARTITION BY a, b ORDER BY year) AS next_count FROM collab WHERE a < b"""))
def _(spark, d):
    return forecast.next_year(graph.collaborations(t.affiliated(spark, d)).filter("a < b"))


#: A cell of one unit, in the order of the gates: weights of input and state, and offsets.
_UNIT = {"w": (0.5, -0.3, 0.8), "u": (0.2, 0.4, -0.6), "b": (0.1, 0.0, -0.1), "c": (0.0, 0.2, 0.05)}


def _gate(k: int, h: str, x: str) -> str:
    part = lambda w, o, v: f"({_UNIT[w][k]} * {v} + {_UNIT[o][k]})"
    return part("w", "b", x), part("u", "c", h)


def _unit_sql(h: str, x: str) -> str:
    sigmoid = lambda k: "1 / (1 + exp(-({} + {})))".format(*_gate(k, h, x))
    given, kept = _gate(2, h, x)
    return f"(1 - {sigmoid(1)}) * tanh({given} + {sigmoid(0)} * {kept}) + {sigmoid(1)} * {h}"


@query("w11_carry_state", sql(f""", f AS (SELECT a, year, sum(papers_count) / 1000 AS x FROM collab GROUP BY ALL)
SELECT a, round(list_reduce(list_prepend(0::DOUBLE, list(x::DOUBLE ORDER BY year)), lambda h, x: {_unit_sql("h", "x")}), 6) AS state FROM f GROUP BY 1"""))
def _(spark, d):
    cell = forecast.Cell(*(np.array(_UNIT[k]).reshape(3, -1) if k in "wu" else np.array(_UNIT[k]) for k in "wubc"))
    by = graph.collaborations(t.affiliated(spark, d)).groupBy(F.col("a").alias("id"), "year").agg((F.sum("papers_count") / 1000).alias("x"))
    states = forecast.carry_states(by.select("id", "year", F.array("x").alias("x")), cell)
    return states.groupBy(F.col("id").alias("a")).agg(F.round(F.max_by(F.get("state", F.lit(0)), "year"), 6).alias("state"))
