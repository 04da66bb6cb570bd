"""Joins, resolution, verdicts and layout over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.operators import layout, linkage, resolve, verdict
from scholium.plans.catalog import query
from scholium.plans.fuzzy_sql import scored
from scholium.sources import readers, testdata as t
from scholium.sources.testdata import sql


def _cands(spark, d):
    """Candidates: events, with decisions by their number."""
    e = F.col("event_id")
    tool = F.when(e % 3 == 0, "merge").otherwise("registry")
    items = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("id"), F.when(i == 2, "merge").otherwise(tool).alias("tool")))
    return t.table(spark, d, "events").select(
        e.alias("candidate_id"), (e % 4).cast("int").alias("n_specialists"),
        F.when(e % 5 == 0, F.array().cast("array<struct<id:string,tool:string>>")).otherwise(items).alias("evidence"),
        F.when(e % 7 == 0, None).when(e % 3 == 0, "accept").when(e % 3 == 1, "reject").otherwise("retry").alias("decision"),
        F.when(e % 7 != 0, (e % 100) / 100).alias("confidence"),
        F.when(e % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(e % 3 == 2, "look again").alias("retry_hint"),
    )


_V = """WITH c AS (SELECT event_id AS candidate_id, event_id % 4 AS k, event_id % 5 = 0 AS bare, event_id % 7 = 0 AS nojudge,
  CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'retry' END AS dec, (event_id % 100) / 100 AS conf, event_id % 2 = 0 AS ids, event_id % 3 AS m FROM events),
v1 AS (SELECT *, CASE WHEN dec = 'accept' AND NOT ids AND bare THEN 'reject' ELSE dec END AS d1,
  CASE WHEN ids THEN 'x' WHEN dec = 'accept' AND NOT bare THEN 'e1,e2,e3' ELSE '' END AS i1 FROM c),
v AS (SELECT candidate_id, CASE WHEN nojudge THEN CASE WHEN k >= 2 THEN 'accept' ELSE 'reject' END WHEN d1 = 'reject' AND k >= 2 THEN 'accept' ELSE d1 END AS decision,
  CASE WHEN nojudge THEN CASE WHEN k >= 2 THEN 0.45 ELSE 0.2 END WHEN d1 = 'reject' AND k >= 2 THEN least(conf + 0.1::DOUBLE, 0.55) ELSE conf END::DOUBLE AS confidence, nojudge,
  CASE WHEN nojudge THEN CASE WHEN k < 2 OR bare THEN '' WHEN m = 0 THEN 'e1,e2,e3,e4' ELSE 'e2' END
    WHEN d1 = 'reject' AND k >= 2 AND i1 = '' THEN CASE WHEN bare THEN '' WHEN m = 0 THEN 'e1' ELSE 'e2' END ELSE i1 END AS evidence_ids,
  (nojudge OR d1 = 'reject') AND k >= 2 AS salvage, CASE WHEN NOT nojudge AND m = 2 THEN 'look again' END AS retry_hint FROM v1)
"""


@query("v01_verdicts", _V + "SELECT candidate_id, decision, round(confidence, 9) AS confidence, CASE WHEN nojudge THEN 'low' WHEN confidence >= 0.7::DOUBLE THEN 'high' WHEN confidence >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS confidence_band, evidence_ids, salvage, retry_hint FROM v")
def _(spark, d):
    v = verdict.judge(_cands(spark, d))
    return v.withColumn("confidence", F.round("confidence", 9)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("v02_unjudged", _V + "SELECT candidate_id, decision, confidence FROM v WHERE nojudge")
def _(spark, d):
    return verdict.judge(_cands(spark, d).filter("decision is null")).select("candidate_id", "decision", "confidence")


@query("j01_accepted_candidates", _V + "SELECT candidate_id, event_type AS specialist FROM v JOIN events ON event_id = candidate_id WHERE decision = 'accept'")
def _(spark, d):
    c = t.table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), F.col("event_type").alias("specialist"))
    return verdict.accepted(verdict.judge(_cands(spark, d)).select("candidate_id", "decision"), c).select("candidate_id", "specialist")


@query("j02_judgments", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type END AS decision FROM events")
def _(spark, d):
    e = t.table(spark, d, "events")
    given = e.filter("event_id % 7 > 0").select("event_id", F.col("event_type").alias("decision"))
    return e.select("event_id").join(given, "event_id", "left")


@query("j03_projected_confidence", _V + "SELECT candidate_id, round(confidence, 9) AS confidence FROM v WHERE decision = 'accept'")
def _(spark, d):
    c = _cands(spark, d)
    v = verdict.judge(c).withColumn("pos", F.lit(0))
    return verdict.projected_confidence(c.select("candidate_id"), v).select("candidate_id", F.round("confidence", 9).alias("confidence"))


@query("v03_evidence", """SELECT event_id AS candidate_id, tool, score FROM (SELECT event_id, 'merge' AS tool, 1.0::DOUBLE AS score FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'registry', (event_id % 100) / 100 FROM events WHERE (event_id % 100) / 100 >= 0.8 UNION ALL SELECT event_id, 'email', (event_id % 100) / 100 FROM events WHERE (event_id % 100) / 100 >= 0.7
  UNION ALL SELECT event_id, 'authorship', 0.9 FROM events WHERE event_id % 9 = 0)""")
def _(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), F.lit("r").alias("result"), ((F.col("event_id") % 100) / 100).alias("score"))
    one = e.withColumn("score", F.lit(1.0))
    return verdict.collect_evidence(one.filter("candidate_id % 4 = 0"), e, e, e.filter("candidate_id % 9 = 0")).select("candidate_id", "tool", "score")


@query("f17_trails", """SELECT user_id AS candidate_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, max(value) AS max_confidence FROM events GROUP BY 1""")
def _(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").alias("candidate_id"), F.lit(0).alias("ord"), F.col("event_type").alias("tool"), F.col("value").alias("score"))
    return verdict.trail(e).select("candidate_id", F.array_join("sources", ",").alias("sources"), "max_confidence")


@query("f12_thresholds", "SELECT count(*) FILTER ((event_id % 100) / 100 >= 0.8)::BIGINT AS registry, count(*) FILTER ((event_id % 100) / 100 >= 0.7)::BIGINT AS email FROM events")
def _(spark, d):
    s = (F.col("event_id") % 100) / 100
    return t.table(spark, d, "events").agg(F.count_if(s >= 0.8).alias("registry"), F.count_if(s >= 0.7).alias("email"))


@query("v04_retries", "SELECT event_id AS candidate_id, s AS specialist FROM events, (VALUES ('header'), ('email')) x(s) WHERE event_id % 7 > 0 AND event_id % 3 = 2")
def _(spark, d):
    c = _cands(spark, d)
    listed = c.select("candidate_id", F.array(F.lit("header"), F.lit("email")).alias("specialists"))
    return verdict.to_retry(c, listed, 0).select("candidate_id", "specialist")


@query("x12_after_retry", "SELECT event_id AS id, event_type AS specialist FROM events WHERE event_type <> 'click' UNION ALL SELECT -event_id, event_type FROM events WHERE event_type = 'click' AND event_id % 2 = 0")
def _(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("specialist"))
    new = e.filter("specialist = 'click' and id % 2 = 0").withColumn("id", -F.col("id"))
    return verdict.after_retry(e, new, new)


@query("a12_merge_candidates", sql("""SELECT name::VARCHAR AS key, name::VARCHAR AS name, string_agg(DISTINCT specialist, ',' ORDER BY specialist) AS specialists,
  CASE WHEN count(DISTINCT specialist) >= 2 THEN 'high' ELSE 'medium' END AS confidence, 'Agreed by: ' || string_agg(DISTINCT specialist, ', ' ORDER BY specialist) AS evidence,
  (SELECT string_agg(aff, ',' ORDER BY p) FROM (SELECT aff, min(seq) AS p FROM spec s WHERE s.name = spec.name AND aff IS NOT NULL GROUP BY 1)) AS affiliations FROM spec WHERE length(name::VARCHAR) >= 2 GROUP BY name"""))
def _(spark, d):
    rows = t.specialists(spark, d).select(F.col("name").cast("string").alias("name"), "aff", "specialist", F.col("seq").alias("pos"))
    m = resolve.merge_candidates(rows)
    return m.withColumn("affiliations", F.array_join("affiliations", ",")).withColumn("specialists", F.array_join("specialists", ","))


@query("w04_ordered_distinct", sql("SELECT aff AS v, row_number() OVER (ORDER BY min(seq))::INT AS place FROM spec WHERE aff IS NOT NULL GROUP BY 1"))
def _(spark, d):
    return resolve.ordered_distinct(t.specialists(spark, d).filter("aff is not null").select(F.col("aff").alias("v"), "seq"), "v", "seq")


@query("j04_scored_papers", sql("SELECT paper_id, count(*)::BIGINT AS n FROM pred WHERE paper_id IN (SELECT paper_id FROM gold) GROUP BY 1"))
def _(spark, d):
    return t.predicted(spark, d).join(t.gold(spark, d).select("paper_id").distinct(), "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n"))


def _names(spark, d):
    a = t.authors(spark, d).select("author_id", "name")
    g = t.gold(spark, d).select("paper_id", F.col("name").alias("author_id")).distinct().join(a, "author_id")
    p = t.predicted(spark, d).select("paper_id", F.col("name").alias("author_id")).distinct().join(a, "author_id")
    return p.select("paper_id", F.lower("name").alias("name"), "author_id"), g.select("paper_id", F.lower("name").alias("name"), F.col("author_id").alias("pos"))


@query("j05_greedy_pairs")
def _(spark, d):
    p, g = _names(spark, d)
    return resolve.greedy_pairs(p, g)


@query("j06_first_match", sql("SELECT DISTINCT p.paper_id, lower(author.name) AS pred, lower(author.name) AS gold FROM (SELECT DISTINCT paper_id, name FROM pred) p JOIN gold g ON g.paper_id = p.paper_id AND g.name = p.name JOIN author ON author_id = p.name"))
def _(spark, d):
    p, g = _names(spark, d)
    return resolve.first_fuzzy(p, g, 100.0)


@query("j07_enrich", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '!' ELSE 'kept' END AS aff FROM supplier")
def _(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    rows = s.withColumn("aff", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("kept"))
    extra = s.select(F.upper("name").alias("name"), F.concat("name", F.lit("!")).alias("aff"), F.lit(1).alias("pos")).union(s.select("name", F.lit("older"), F.lit(0)))
    return resolve.enrich(rows, extra, ["aff"]).select("s_suppkey", "aff")


@query("j08_last_attribute", sql("SELECT paper_id, name, max(aff)::INT AS aff FROM pred GROUP BY ALL"))
def _(spark, d):
    from scholium.operators.metrics import last_by_name

    return last_by_name(t.predicted(spark, d).withColumn("pos", F.col("aff")), ["aff"]).select("paper_id", "name", F.col("aff").cast("int").alias("aff"))


@query("j09_intersection", sql("SELECT paper_id, name, aff FROM gold INTERSECT SELECT paper_id, name, aff FROM pred"))
def _(spark, d):
    return t.gold(spark, d).join(t.predicted(spark, d), ["paper_id", "name", "aff"], "left_semi")


@query("j15_name_overlap", "SELECT s_suppkey, regexp_extract(s_name, '#0*(\\d+)$', 1)::BIGINT % 2 = 0 AS overlap FROM supplier".replace("\\\\", "\\"))
def _(spark, d):
    other = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Dr "), F.lower("s_name"))).otherwise("Nobody Else")
    return t.table(spark, d, "supplier").select("s_suppkey", resolve.name_overlap(F.col("s_name"), other).alias("overlap"))


@query("j16_either_contains", """WITH c AS (SELECT p_size, p_type, count(*) AS n FROM part GROUP BY ALL),
m AS (SELECT a.p_size, a.p_type, sum(b.n) - 1 AS n_links FROM c a JOIN c b ON a.p_size = b.p_size AND (contains(a.p_type, b.p_type) OR contains(b.p_type, a.p_type)) GROUP BY ALL)
SELECT p_partkey, p_size, p_type, n_links::BIGINT AS n_links FROM part JOIN m USING (p_size, p_type)""")
def _(spark, d):
    """Each part with its class, the size and type, and the number of other parts whose type holds its own or is held by it."""
    p = t.table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    c = p.groupBy("p_size", "p_type").agg(F.count("*").alias("n"))
    o = c.select("p_size", F.col("p_type").alias("o_type"), F.col("n").alias("o_n"))
    m = c.join(o, "p_size").filter(resolve.either_contains(F.col("p_type"), F.col("o_type"))).groupBy("p_size", "p_type").agg((F.sum("o_n") - 1).alias("n_links"))
    return p.join(m, ["p_size", "p_type"]).select("p_partkey", "p_size", "p_type", "n_links")


def _kb(spark, d):
    n = t.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("variant"), F.col("n_name").alias("canonical"))


def _texts(spark, d):
    n = t.table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    return n.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("Univ. of "), F.col("n_name"), F.lit(" Dept"))).when(k == 2, F.concat(F.col("n_name"), F.lit("x1"))).otherwise(F.concat(F.lit("??"), F.col("n_nationkey").cast("string"))).alias("text"))


_TX = "tx AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Univ. of ' || n_name || ' Dept' WHEN 2 THEN n_name || 'x1' ELSE '??' || n_nationkey END AS text FROM nation)"


_NAMES = f"""tx AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN 'Dept. of ' || p_name || ' ' || p_type
  WHEN 2 THEN p_type || ' ' || replace(p_name, 'l', '1') || ' ' || replace(p_brand, 'Brand#', '') ELSE p_brand END AS text FROM part),
kb AS (SELECT lower(p_name || ' ' || p_type) AS v, min(p_partkey) AS pos, min(p_name || ' ' || p_type) AS c FROM part GROUP BY 1),
h AS (SELECT text, (SELECT arg_min(c, pos) FROM kb WHERE v = lower(text)) AS e, (SELECT arg_min(c, pos) FROM kb WHERE contains(lower(text), v) OR contains(v, lower(text))) AS p FROM tx),
pairs AS (SELECT text, pos, c, lower(text) AS a, v AS b FROM h JOIN kb ON 200 * least(length(text), length(v)) >= 80 * (length(text) + length(v)) WHERE e IS NULL AND p IS NULL),
{scored("pairs", "text, pos, c")},
near AS (SELECT text, max({{'s': score, 'p': -pos, 'c': c}}) AS best FROM scored WHERE score >= 80 GROUP BY text),
r AS (SELECT text, coalesce(e, p, near.best.c, text) AS canonical,
  (CASE WHEN e IS NOT NULL OR p IS NOT NULL THEN 0.95 WHEN near.best IS NOT NULL THEN 0.9 * near.best.s / 100 ELSE 0.3 END)::DOUBLE AS confidence,
  CASE WHEN e IS NOT NULL OR p IS NOT NULL THEN 'kb' WHEN near.best IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS source FROM h LEFT JOIN near USING (text))"""


def _written(spark, d):
    """Names as written (exact, within others, in another order with slips, unknown) and the registry of their right forms."""
    p = t.table(spark, d, "part")
    name, k = F.concat("p_name", F.lit(" "), "p_type"), F.col("p_size") % 4
    slip = F.concat("p_type", F.lit(" "), F.replace(F.col("p_name"), F.lit("l"), F.lit("1")), F.lit(" "), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")))
    texts = p.select(F.when(k == 0, name).when(k == 1, F.concat(F.lit("Dept. of "), name)).when(k == 2, slip).otherwise(F.col("p_brand")).alias("text"))
    known = p.groupBy(F.lower(name).alias("variant")).agg(F.min("p_partkey").alias("pos"), F.min(name).alias("canonical"))
    return texts, known


@query("v05_normalise_cascade", f"WITH {_NAMES} SELECT text, canonical, confidence, source FROM r")
def _(spark, d):
    return resolve.lookup_tiers(*_written(spark, d))


@query("j17_exact_lookup", f"WITH {_TX} SELECT text, n_name AS canonical FROM tx JOIN nation ON lower(n_name) = lower(text)")
def _(spark, d):
    return resolve.lookup_tiers(_texts(spark, d), _kb(spark, d)).join(_kb(spark, d).select("variant"), F.lower("text") == F.col("variant"), "left_semi").select("text", "canonical")


@query("j19_fuzzy_lookup", f"""WITH tx AS (SELECT DISTINCT translate(n_name, 'A', 'B') AS text FROM nation),
pairs AS (SELECT text, n_nationkey AS pos, n_name AS c, lower(n_name) AS v, lower(text) AS a, lower(n_name) AS b FROM tx, nation),
{scored("pairs", "text, pos, c, v")},
near AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, pos) AS turn FROM scored),
kb AS (SELECT text, coalesce(arg_min(c, pos) FILTER (lower(text) = v), arg_min(c, pos) FILTER (contains(lower(text), v) OR contains(v, lower(text)))) AS hit FROM scored GROUP BY 1)
SELECT text, coalesce(hit, CASE WHEN score >= 60 THEN c END, text) AS canonical, CASE WHEN hit IS NOT NULL THEN 0.95 WHEN score >= 60 THEN 0.9 * score / 100 ELSE 0.3 END::DOUBLE AS confidence,
  CASE WHEN hit IS NOT NULL THEN 'kb' WHEN score >= 60 THEN 'fuzzy' ELSE 'none' END AS source FROM near JOIN kb USING (text) WHERE turn = 1""")
def _(spark, d):
    names = _kb(spark, d)
    typo = names.select(F.translate("canonical", "A", "B").alias("text"))
    return resolve.lookup_tiers(typo, names, threshold=60.0)


@query("a43_normaliser_stats", f"WITH {_NAMES} SELECT source, count(*)::BIGINT AS n, round(avg(confidence), 9) AS confidence FROM r GROUP BY 1")
def _(spark, d):
    from scholium.operators.analytics import confidence_stats

    s = confidence_stats(resolve.lookup_tiers(*_written(spark, d)), "text")
    return s.select("source", "n", F.round("confidence", 9).alias("confidence"))


@query("a51_batch_normalise", f"WITH {_NAMES}, o AS (SELECT CASE p_size % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN 'Dept. of ' || p_name || ' ' || p_type WHEN 2 THEN p_type || ' ' || replace(p_name, 'l', '1') || ' ' || replace(p_brand, 'Brand#', '') ELSE p_brand END AS text FROM part) SELECT text, count(*)::BIGINT AS n, any_value(canonical) AS canonical, any_value(source) AS source FROM o JOIN r USING (text) GROUP BY 1")
def _(spark, d):
    texts, known = _written(spark, d)
    found = resolve.lookup_tiers(texts, known)
    return texts.groupBy("text").agg(F.count("*").alias("n")).join(found, "text").select("text", "n", "canonical", "source")


@query("v06_row_confidence", "SELECT c_custkey, least(0.85::DOUBLE, (c_custkey % 10) / 10) AS merged, greatest(0.85::DOUBLE, (c_custkey % 10) / 10) AS routed FROM customer")
def _(spark, d):
    k = (F.col("c_custkey") % 10) / 10
    return t.table(spark, d, "customer").select("c_custkey", resolve.combined_confidence(F.lit(0.85), k).alias("merged"), resolve.combined_confidence(F.lit(0.85), k, True).alias("routed"))


@query("j14_differing_spans", "SELECT n_nationkey AS doc_id, p AS parser, CASE p WHEN 'a' THEN 'Alpha beta ' || n_nationkey ELSE 'zzzz' END AS text FROM nation, (VALUES ('a'), ('b')) x(p) WHERE n_nationkey % 2 = 0")
def _(spark, d):
    n = t.table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("doc_id"), F.lit("header").alias("region"), F.lit("a").alias("parser"), F.concat(F.lit("Alpha beta "), F.col("n_nationkey").cast("string")).alias("text"))
    b = a.select("doc_id", "region", F.lit("b").alias("parser"), F.when(F.col("doc_id") % 2 == 0, "zzzz").otherwise(F.upper("text")).alias("text"))
    return resolve.differing_spans(a.union(b), "a", "b").select("doc_id", "parser", "text")


@query("v07_merge_annotations", "SELECT l AS paper_id, p AS pos, CASE WHEN l % 3 = 0 THEN 'b' || l ELSE 'a' || l END AS aff, CASE WHEN l % 3 = 1 THEN 1 ELSE 0 END::INT AS n_conflicts FROM (SELECT o_orderkey AS l, 0 AS p FROM orders)")
def _(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit(0).alias("pos"))
    s, k = F.col("paper_id").cast("string"), F.col("paper_id") % 3
    a = o.withColumn("aff", F.when(k == 0, "").otherwise(F.concat(F.lit("a"), s)))
    b = o.withColumn("aff", F.when(k == 2, F.concat(F.lit("a"), s)).otherwise(F.concat(F.lit("b"), s)))
    return resolve.merge_annotations(a, b, ["aff"]).select("paper_id", "pos", "aff", F.size("conflicts").alias("n_conflicts"))


@query("j22_outer_zip", "SELECT o_orderkey AS paper_id, p AS pos, CASE WHEN p = 0 THEN 'a' ELSE 'b' END AS aff FROM orders, (VALUES (0), (1)) x(p)")
def _(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"))
    a = o.select("paper_id", F.lit(0).alias("pos"), F.lit("a").alias("aff"))
    b = o.select("paper_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("aff", F.when(F.col("pos") == 0, "").otherwise("b"))
    return resolve.merge_annotations(a, b, ["aff"]).select("paper_id", "pos", "aff")


@query("v08_parser_consensus", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'docling' ELSE 'marker' END AS parser FROM documents")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id")
    spans = docs.withColumn("parser", F.lit("marker")).union(docs.filter("doc_id % 2 = 0").withColumn("parser", F.lit("docling")))
    return layout.parser_consensus(spans, ["docling", "marker"])


@query("v08_parser_vote", """WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey, min(l_quantity) AS q, min(l_discount) AS d FROM lineitem GROUP BY ALL),
n AS (SELECT doc_id, 1 + (min(q) < 25)::INT + (min(d) < 0.05)::INT AS present FROM l GROUP BY 1),
v AS (SELECT doc_id, md5(doc_id || ':' || l_partkey) AS text, l_partkey, (1 + (q < 25)::INT + (d < 0.05)::INT)::INT AS votes FROM l)
SELECT doc_id, text, votes FROM v JOIN n USING (doc_id) WHERE 2 * votes > present""")
def _(spark, d):
    """One parser gives every line of an order, the second those of few items, the third those of little discount."""
    line = t.lines(spark, d).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("pos")).agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    text = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    spans = line.select("doc_id", F.lit("header").alias("region"), F.lit("docling").alias("parser"), "pos", text.alias("text"))
    for parser, kept in (("marker", "q < 25"), ("nougat", "d < 0.05")):
        spans = spans.union(line.filter(kept).select("doc_id", F.lit("header"), F.lit(parser), "pos", text))
    return layout.consensus_by_vote(spans, ["docling", "marker", "nougat"]).select("doc_id", "text", "votes")


@query("v09_author_clusters", f"""WITH RECURSIVE n AS (SELECT p_brand AS block, p_name AS k, min(p_partkey) AS node FROM part GROUP BY ALL),
pairs AS (SELECT x.node AS u, y.node AS v, x.k AS a, y.k AS b FROM n x JOIN n y ON x.block = y.block AND x.k < y.k AND 200 * least(length(x.k), length(y.k)) >= 85 * (length(x.k) + length(y.k))),
{scored("pairs", "u, v")},
l AS (SELECT u, v FROM scored WHERE score >= 85 UNION ALL SELECT v, u FROM scored WHERE score >= 85),
r AS (SELECT node AS x, node AS y FROM n UNION SELECT r.x, l.v FROM r JOIN l ON l.u = r.y),
c AS (SELECT x, min(y) AS cluster_id FROM r GROUP BY 1)
SELECT p_partkey AS record_id, cluster_id FROM part JOIN n ON block = p_brand AND k = p_name JOIN c ON x = node""")
def _(spark, d):
    """Parts of one brand whose names differ in little."""
    p = t.table(spark, d, "part")
    return resolve.clusters(p.select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("block"), F.col("p_name").alias("name")), threshold=85.0)


@query("v09_author_linkage")
def _(spark, d):
    """Parts as mentions of authors: their suppliers as co-authors, the brand as affiliation, the type as venue."""
    lines = t.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("coauthors"))
    p = t.table(spark, d, "part").join(lines, "p_partkey", "left")
    records = p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"), "coauthors", F.col("p_brand").alias("affiliation"), F.col("p_type").alias("venue"))
    return linkage.author_clusters(records)


@query("v10_email_institutions", "SELECT c_custkey AS doc_id, (c_custkey % 25)::INT AS inst_id FROM customer WHERE c_custkey % 25 < 20")
def _(spark, d):
    c = t.table(spark, d, "customer")
    mails = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("a@cs.u"), (F.col("c_custkey") % 25).cast("string"), F.lit(".edu")).alias("email"))
    domains = t.table(spark, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string"), F.lit(".edu")).alias("domain"), F.col("n_nationkey").alias("inst_id"))
    return verdict.from_email(mails, domains).select("doc_id", "inst_id")


@query("v11_enrichment_cascade", "SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN 's2' WHEN o_orderkey % 3 = 0 THEN 'openalex' ELSE 'own' END AS source FROM orders")
def _(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"))
    return readers.cascade([o.filter("paper_id % 2 = 0").withColumn("source", F.lit("s2")), o.filter("paper_id % 3 = 0").withColumn("source", F.lit("openalex")), o.withColumn("source", F.lit("own"))], "paper_id")


@query("v12_systems_by_split", sql("SELECT CASE WHEN paper_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, venue_key AS system, count(*)::BIGINT AS n FROM paper GROUP BY ALL"))
def _(spark, d):
    p = t.papers(spark, d)
    return p.groupBy(F.when(F.col("paper_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("venue_key").alias("system")).agg(F.count("*").alias("n"))


@query("f13_row_validation", "SELECT c_custkey, least(1, greatest(0, c_acctbal / 5000)) AS confidence FROM customer WHERE c_custkey % 4 > 0")
def _(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, " x ").otherwise(F.col("c_name")).alias("name"), (F.col("c_acctbal") / 5000).alias("confidence"))
    return verdict.valid_rows(c)[0].select("c_custkey", "confidence")


@query("f14_gold_problems", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'missing doi' WHEN 1 THEN 'missing author_name' WHEN 2 THEN 'unknown type' ELSE 'bad ror_id' END AS problems FROM nation")
def _(spark, d):
    k = F.col("n_nationkey") % 4
    p = verdict.gold_problems(F.when(k != 0, "10.1/x"), F.array(F.when(k != 1, "Ann")), F.array(F.when(k == 2, "zoo").otherwise("company")), F.array(F.when(k == 3, "05a").otherwise("")))
    return t.table(spark, d, "nation").select("n_nationkey", F.array_join(p, ";").alias("problems"))


@query("g09_entity_links", "WITH m AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS mention, p_type AS kind FROM part), h AS (SELECT mention, kind, p_partkey AS id, row_number() OVER (PARTITION BY mention, kind ORDER BY p_partkey) AS turn FROM m JOIN part ON p_type = kind AND contains(lower(p_name || ' ' || p_brand), lower(mention))) SELECT mention, kind, id FROM h WHERE turn <= 3")
def _(spark, d):
    """The words of the parts' names as mentions of parts of their type; the first three stand."""
    p = t.table(spark, d, "part")
    mentions = p.select(F.explode(F.split("p_name", " ")).alias("mention"), F.col("p_type").alias("kind"))
    names = p.select(F.col("p_type").alias("kind"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"), F.col("p_partkey").alias("id"))
    return resolve.link_mentions(mentions, names)


_MD = "documents_md AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || 'Ann Lee' || chr(10) || chr(10) || '## Abstract' || chr(10) || text || chr(10) || '* Equal work.' || chr(10) || 'Acknowledgements' || chr(10) || 'We thank X.' || chr(10) || 'References' || chr(10) || '[1] y' AS md FROM documents)"


def _md(spark, d):
    parts = [F.concat(F.lit("# Title "), F.col("doc_id").cast("string")), F.lit("Ann Lee"), F.lit(""), F.lit("## Abstract"), F.col("text"), F.lit("* Equal work."), F.lit("Acknowledgements"), F.lit("We thank X."), F.lit("References"), F.lit("[1] y")]
    return t.table(spark, d, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


@query("c37_header_lines", "SELECT doc_id, 0 AS pos, 'Title ' || doc_id AS text, 0.9::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 1, 'Ann Lee', 0.78 FROM documents")
def _(spark, d):
    return layout.header_lines(_md(spark, d))


@query("c39_footnote_lines", r"WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || '* Equal work.', chr(10))) AS line FROM documents) SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE regexp_matches(line, '^\s*[*†‡§¶\d¹²³⁴⁵⁶⁷⁸⁹⁰]+[.\s].+') AND length(trim(line)) < 200 GROUP BY 1")
def _(spark, d):
    return layout.footnote_lines(_md(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("c40_acknowledgements", "SELECT doc_id, 'We thank X.' AS text FROM documents")
def _(spark, d):
    return layout.acknowledgement_lines(_md(spark, d)).select("doc_id", "text")


def _marked_up(spark, d):
    parts = [F.concat(F.lit("# Title "), F.col("doc_id").cast("string")), F.lit("Ann Lee"), F.lit("# 1. Start"), F.col("text"), F.lit("## Acknowledgements"), F.lit(""), F.lit("We thank X."), F.lit("And Y."), F.lit("## References"), F.lit("[1] y")]
    return t.table(spark, d, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


@query("c37_headers_by_parser", "SELECT doc_id, 'nougat' AS parser, '# Title ' || doc_id AS text, 0.8::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'nougat', 'Ann Lee', 0.8 FROM documents UNION ALL SELECT doc_id, 'marker', 'Title ' || doc_id, 0.9 FROM documents UNION ALL SELECT doc_id, 'marker', 'Ann Lee', 0.78 FROM documents")
def _(spark, d):
    """Each parser on text with the headings it looks for."""
    nougat = layout.headers_by(_marked_up(spark, d), "nougat").select("doc_id", F.lit("nougat").alias("parser"), "text", "confidence")
    return nougat.union(layout.headers_by(_md(spark, d), "marker").select("doc_id", F.lit("marker"), "text", "confidence"))


@query("c40_by_parser", "SELECT doc_id, p AS parser, 'We thank X.' || chr(10) || 'And Y.' AS text, c::DOUBLE AS confidence FROM documents, (VALUES ('marker', 0.82), ('nougat', 0.8)) x(p, c) UNION ALL SELECT doc_id, 'pymupdf', 'We thank X.', 0.75 FROM documents")
def _(spark, d):
    out = None
    for parser in ("marker", "nougat", "pymupdf"):
        units = layout.lines(_md(spark, d) if parser == "pymupdf" else _marked_up(spark, d)).withColumnRenamed("line", "text")
        one = layout.acknowledgements_by(units, parser).select("doc_id", F.lit(parser).alias("parser"), "text", "confidence")
        out = one if out is None else out.union(one)
    return out


@query("c37_docling_regions", """WITH x AS (SELECT user_id AS doc_id, event_id AS pos, CASE event_type WHEN 'click' THEN 'section_header' WHEN 'view' THEN 'text' WHEN 'error' THEN 'title' ELSE 'footnote' END AS label,
  CASE WHEN value < 25 THEN 'Acknowledgement' ELSE 'Results' END AS text, event_id // 2000 AS page FROM events),
m AS (SELECT *, coalesce(last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) = 'Acknowledgement', false) AS ack FROM x)
SELECT doc_id, pos, CASE WHEN ack THEN 'acknowledgements' WHEN label = 'footnote' THEN 'footnotes' ELSE 'header' END AS region, text,
  CASE WHEN ack THEN 0.88 WHEN label = 'footnote' THEN 0.92 WHEN label = 'title' THEN 0.97 ELSE 0.82 END::DOUBLE AS confidence FROM m
WHERE NOT (label = 'section_header' AND text = 'Acknowledgement') AND (ack OR label IN ('footnote', 'title') OR page = 0)""")
def _(spark, d):
    kind = F.col("event_type")
    label = F.when(kind == "click", "section_header").when(kind == "view", "text").when(kind == "error", "title").otherwise("footnote")
    items = t.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 2000).alias("page"), label.alias("label"),
        F.when(F.col("value") < 25, "Acknowledgement").otherwise("Results").alias("text"),
    )
    return layout.docling_regions(items)


@query("w07_sections", "SELECT doc_id, 1::BIGINT AS n FROM documents")
def _(spark, d):
    return layout.acknowledgement_lines(_md(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("c36_placed_regions", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 100 < 35 AND l_linenumber = 1 THEN 'header' ELSE 'footnotes' END AS region, least(1, (l_quantity::INT % 14) / 12) AS confidence FROM lineitem WHERE (l_linenumber = 1 AND l_partkey % 100 < 35) OR (l_partkey % 100 > 82 AND l_quantity::INT % 14 <= 9)")
def _(spark, d):
    b = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("page"), (F.col("l_partkey") % 100).alias("top"), F.lit(100).alias("height"), (F.col("l_quantity").cast("int") % 14).alias("font"))
    return layout.placed_regions(b).select("l_orderkey", "l_linenumber", "region", "confidence")


@query("w05_first_pages", "SELECT c_custkey % 50 AS doc_id, 'a@b.org' AS email, min(c_custkey // 50)::BIGINT AS page FROM customer GROUP BY 1")
def _(spark, d):
    k = F.col("c_custkey")
    pages = t.table(spark, d, "customer").select((k % 50).alias("doc_id"), F.floor(k / 50).alias("page"), F.lit("write A@b.org or a@B.ORG").alias("text"))
    return layout.first_pages(pages)


@query("f10_region_filter", "SELECT doc_id FROM documents WHERE source = 'src3'")
def _(spark, d):
    return layout.disagreements(t.table(spark, d, "documents").select("doc_id", F.col("source").alias("region")), "src3").select("doc_id")
