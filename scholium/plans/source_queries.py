"""Files, payloads, lookups and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators import graph, metrics
from scholium.plans.catalog import query
from scholium.plans.fuzzy_sql import scored
from scholium.plans.ingest import ingest_items
from scholium.plans.metric_queries import REPLAY
from scholium.sources import readers, sinks, testdata as t
from scholium.sources.scratch import scratch
from scholium.sources.testdata import sql


def _flat(spark, d):
    f = t.flat_rows(spark, d).select(
        F.col("paper_id").cast("string").alias("paper_id"), F.lit("t").alias("paper_title"), F.lit("").alias("published_date"), F.lit("NA").alias("categories"),
        F.col("name").alias("author_name"), F.col("inst_name").alias("raw_affiliation"), F.col("inst_name").alias("normalized_affiliation"), "country",
        F.lit("XX").alias("country_code"), "org_type", F.lit(0.5).alias("confidence"),
    )
    return f


@query("s01_csv_scan", sql("SELECT paper_id::VARCHAR AS paper_id, name AS author_name, country, org_type, 0.5::DOUBLE AS confidence, true AS empty FROM flat"))
def _(spark, d):
    path = scratch(spark, "flat")
    sinks.write_report(_flat(spark, d), spark.range(1), path, "now")
    rows = readers.read_affiliations(spark, f"{path}/affiliations_now.csv")
    return rows.select("paper_id", "author_name", "country", "org_type", "confidence", (F.col("published_date").isNull() & F.col("categories").isNull()).alias("empty"))


@query("k01_report", sql("SELECT count(DISTINCT paper_id)::BIGINT AS papers, count(*)::BIGINT AS n_rows FROM flat"))
def _(spark, d):
    path = scratch(spark, "report")
    flat = t.flat_rows(spark, d)
    sinks.write_report(_flat(spark, d), flat.agg(F.countDistinct("paper_id").alias("papers"), F.count("*").alias("n_rows")), path, "now")
    return spark.read.schema("papers bigint, n_rows bigint").json(f"{path}/report_now.json")


@query("s04_gold_scan", "SELECT 'p' || n_regionkey AS paper_id, n_name AS name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS pos FROM nation")
def _(spark, d):
    n = t.table(spark, d, "nation")
    author = F.struct(F.col("n_name").alias("name"), F.lit("x").alias("raw_affiliation"))
    papers = n.groupBy(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("paper_id")).agg(F.array_sort(F.collect_list(author)).alias("authors"))
    path = scratch(spark, "gold")
    papers.agg(F.collect_list(F.struct("paper_id", "authors")).alias("papers")).coalesce(1).write.json(path)
    return readers.read_gold(spark, path).select("paper_id", "name", "pos")


def _items(spark, d) -> DataFrame:
    n = t.table(spark, d, "nation")
    line = F.to_json(F.struct(
        F.struct(F.concat(F.lit("doi:10.1/"), F.col("n_nationkey").cast("string")).alias("paper_id"), F.col("n_name").alias("title"), F.lit(2020).alias("year")).alias("canonical_paper"),
        F.array(F.struct(F.lit("c1").alias("candidate_id"), F.col("n_name").alias("author_name"), F.array(F.lit("MIT")).alias("affiliations"))).alias("merged_candidates"),
        F.array(F.struct(F.lit("c1").alias("candidate_id"), F.lit("accept").alias("decision"), F.lit(0.9).alias("confidence"))).alias("verdicts"),
    ))
    return n.select(F.when(F.col("n_nationkey") % 5 == 4, "{broken").otherwise(line).alias("value"))


@query("s05_work_items", "SELECT 'item' AS kind, 'doi:10.1/' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'bad', NULL FROM nation WHERE n_nationkey % 5 = 4")
def _(spark, d):
    path = scratch(spark, "items")
    _items(spark, d).write.text(path)
    items, bad = readers.read_work_items(spark, path)
    return items.select(F.lit("item").alias("kind"), F.col("canonical_paper.paper_id").alias("id")).union(bad.select(F.lit("bad"), F.lit(None).cast("string")))


@query("k02_graph_ingest", "SELECT n_nationkey::VARCHAR AS k, n_name AS title, 2020 AS year FROM nation WHERE n_nationkey % 5 <> 4")
def _(spark, d):
    path = scratch(spark, "ingest")
    _items(spark, d).write.text(path)
    items, _bad = readers.read_work_items(spark, path)
    out = scratch(spark, "graph")
    for _ in range(2):  # items that come again change nothing
        ingest_items(items, out)
    return readers.open_graph(spark, out)["paper"].select(F.regexp_replace("doi", "^.*10.1/", "").alias("k"), "title", "year")


def _stored_graph(spark, d):
    """The test tables' papers, venues, authors and their edges as a stored graph; its folder."""
    papers, folder = t.papers(spark, d), scratch(spark, "graph")
    key = F.col("paper_id").cast("string")
    tables = {
        "author": t.authors(spark, d).select(F.col("author_id").cast("string").alias("canonical_id"), F.array("name").alias("name_variants")),
        "paper": papers.select(key.alias("doi"), "title", "year", "venue_key"),
        "venue": papers.select(F.col("venue_key").alias("key")).distinct(),
        "authored": t.authored(spark, d).select(F.col("author_id").cast("string").alias("author_id"), key.alias("paper_id"), F.col("position").cast("int").alias("position")),
        "published_at": papers.select(key.alias("paper_id"), "venue_key", "year"),
    }
    sinks.write_graph(tables, folder, 1)
    return folder


_COUNTED = """'author' AS name, 4 AS n_columns, count(*) AS n FROM author UNION ALL SELECT 'paper', 9, count(*) FROM paper
  UNION ALL SELECT 'venue', 3, count(DISTINCT venue_key) FROM paper UNION ALL SELECT 'authored', 3, count(*) FROM authored
  UNION ALL SELECT 'published_at', 3, count(*) FROM paper UNION ALL SELECT name, n, 0 FROM (VALUES ('institution', 6), ('topic', 3), ('evidence', 4),
  ('affiliated_at', 5), ('about', 3), ('child_of', 2), ('coauthored_with', 4), ('collaborated_with', 4)) x(name, n)"""


def _counts(spark, d):
    out = None
    for name, table in readers.open_graph(spark, _stored_graph(spark, d)).items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(len(table.columns)).alias("n_columns"), "n")
        out = one if out is None else out.union(one)
    return out


@query("a11_graph_counts", sql(f"SELECT name AS kind, n::BIGINT AS n FROM (SELECT {_COUNTED}) WHERE name IN ('author', 'paper', 'venue', 'institution', 'topic')"))
def _(spark, d):
    return _counts(spark, d).filter(F.col("name").isin("author", "paper", "venue", "institution", "topic")).select(F.col("name").alias("kind"), "n")


@query("s10_graph_schemas", sql(f"SELECT name, n_columns::INT AS n_columns, n::BIGINT AS n FROM (SELECT {_COUNTED})"))
def _(spark, d):
    return _counts(spark, d)


def _manifest(spark, d):
    n = t.table(spark, d, "nation")
    doi = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))
    whole = n.agg(
        F.array_sort(F.collect_list(F.struct(doi.alias("doi"), F.col("n_name").alias("title")))).alias("papers"),
        F.struct(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, doi))).alias("test"), F.array(F.lit("d1")).alias("train"), F.array().cast("array<string>").alias("dev")).alias("splits"),
    )
    path = scratch(spark, "manifest")
    whole.coalesce(1).write.json(path)
    return path


@query("s06_split", "SELECT doi, 'test' AS split FROM (SELECT 'd' || n_nationkey AS doi FROM nation WHERE n_nationkey % 2 = 0) UNION ALL SELECT doi, 'mini' FROM (SELECT 'd' || n_nationkey AS doi FROM nation WHERE n_nationkey % 2 = 0 ORDER BY doi LIMIT 10)")
def _(spark, d):
    path = _manifest(spark, d)
    return readers.read_split(spark, path, "test").select("doi", F.lit("test").alias("split")).union(readers.read_split(spark, path, "mini").select("doi", F.lit("mini")))


def _annotations(spark, d, who, keep):
    n = t.table(spark, d, "nation").filter(keep)
    doi = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))
    return n.select(doi.alias("doi"), F.lit(who).alias("annotator"), F.array(F.struct(F.concat("n_name", F.lit(f" {who}")).alias("author_name"))).alias("annotations"))


def _write_as(rows, folder, suffix):
    """One file per document, named as annotators name them; the rows are a small fixture."""
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = f"{folder}-parts{suffix}"
    rows.withColumn("name", F.col("doi")).coalesce(1).write.partitionBy("name").json(part)
    fs = fs_path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(folder))
    for one in fs.listStatus(fs_path(part)):
        if one.isDirectory():
            for f in fs.listStatus(one.getPath()):
                fs.rename(f.getPath(), fs_path(f"{folder}/{one.getPath().getName().split('=')[1]}{suffix}.json"))


@query("s07_annotation_fallback", "SELECT 'd' || n_nationkey AS doi, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' merged' ELSE ' a' END AS author_name FROM nation")
def _(spark, d):
    folder = scratch(spark, "annotations")
    for suffix, (who, keep) in {"": ("merged", "n_nationkey % 2 = 0"), ".a": ("a", "true"), ".b": ("b", "true")}.items():
        _write_as(_annotations(spark, d, who, keep), folder, suffix)
    return readers.read_annotations(spark, folder).select("doi", "author_name")


@query("j23_annotator_pairs", "SELECT 'd' || n_nationkey AS doi, n_name || ' a' AS a, n_name || ' b' AS b FROM nation WHERE n_nationkey % 3 = 0")
def _(spark, d):
    folder = scratch(spark, "pairs")
    _write_as(_annotations(spark, d, "a", "true"), folder, ".a")
    _write_as(_annotations(spark, d, "b", "n_nationkey % 3 = 0"), folder, ".b")
    a, b = readers.paired_annotations(spark, folder)
    return a.select("doi", "pos", F.col("author_name").alias("a")).join(b.select("doi", "pos", F.col("author_name").alias("b")), ["doi", "pos"]).select("doi", "a", "b")


@query("s08_newest_predictions", "SELECT 'd' || n_nationkey AS doi, 'sys' AS system, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS name FROM nation")
def _(spark, d):
    folder = scratch(spark, "predictions")
    n = t.table(spark, d, "nation")
    for name, keep in (("old", "true"), ("new", "n_nationkey % 2 = 0")):
        rows = n.filter(keep).select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("doi"), F.lit("sys").alias("system"), F.array(F.struct(F.lit(name).alias("author_name"))).alias("authors"))
        _write_as(rows, f"{folder}/{name}", "")
    return readers.read_predictions(spark, folder).select("doi", "system", F.get("authors", F.lit(0))["author_name"].alias("name"))


@query("k03_predictions", sql("SELECT paper_id, venue_key AS system FROM paper "))
def _(spark, d):
    folder = scratch(spark, "written")
    rows = t.papers(spark, d).select("paper_id", F.col("venue_key").alias("system"), F.lit("r1").alias("run_id"))
    sinks.write_predictions(rows, folder)
    return spark.read.parquet(folder).filter("run_id = 'r1'").select("paper_id", F.col("system").cast("string").alias("system"))


@query("s09_judgments", "SELECT 'd' || n_nationkey AS doi, 'j' AS judge, n_regionkey::VARCHAR AS system FROM nation")
def _(spark, d):
    folder = scratch(spark, "judgments")
    n = t.table(spark, d, "nation")
    rows = n.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("doi"), F.lit("j").alias("judge"), F.col("n_regionkey").cast("string").alias("system"), F.array().cast("array<struct<author_name:string,score:int,reason:string>>").alias("scores"), F.lit(0.5).alias("overall_quality"), F.lit("").alias("notes"))
    rows.union(rows).write.parquet(folder)
    return readers.read_judgments(spark, folder).select("doi", "judge", "system")


@query("s11_search", sql("SELECT paper_id FROM paper WHERE venue_key IN ('1-urgent', '2-high') AND published BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' ORDER BY published DESC, paper_id LIMIT 50"))
def _(spark, d):
    p = t.papers(spark, d).withColumn("categories", F.array("venue_key"))
    return readers.search(p, ["1-urgent", "2-high"], "1995-01-01", "1995-12-31", 50).select("paper_id")


@query("s12_author_payloads", "SELECT 'p' || n_nationkey AS paper_id, 0 AS pos, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Inst' END AS aff, CASE WHEN n_nationkey % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM nation")
def _(spark, d):
    n = t.table(spark, d, "nation")
    affs = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Inst"), F.lit("Other"))).otherwise(F.array().cast("array<string>"))
    author = F.struct(F.col("n_name").alias("name"), affs.alias("affiliations"))
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("paperId"), F.array(author).alias("authors"))).alias("data")))
    return readers.parse_s2(n.select(body.alias("body")))


@query("s13_work_payloads", "SELECT 'W' || n_nationkey AS work_id, n_name AS inst, 0.92::DOUBLE AS confidence FROM nation")
def _(spark, d):
    n = t.table(spark, d, "nation")
    inst = F.struct(F.col("n_name").alias("display_name"), F.lit("https://ror.org/x").alias("ror"))
    author = F.struct(F.struct(F.lit("A B").alias("display_name")).alias("author"), F.array(inst).alias("institutions"))
    body = F.to_json(F.struct(F.concat(F.lit("W"), F.col("n_nationkey").cast("string")).alias("id"), F.array(author).alias("authorships")))
    return readers.parse_works(n.select(body.alias("body"))).select("work_id", "inst", "confidence")


@query("s14_registry_lookup", f"""WITH pairs AS (SELECT x.n_regionkey AS block, 'the ' || lower(x.n_name) AS query, y.n_name AS name, 'the ' || lower(x.n_name) AS a, lower(y.n_name) AS b FROM nation x JOIN nation y USING (n_regionkey)),
{scored("pairs", "block, query, name")},
best AS (SELECT *, row_number() OVER (PARTITION BY block, query ORDER BY score DESC, name DESC) AS turn FROM scored)
SELECT block, query, name, score FROM best WHERE turn = 1 AND score >= 50""")
def _(spark, d):
    from scholium.operators.resolve import best_fuzzy

    n = t.table(spark, d, "nation").select(F.col("n_regionkey").alias("block"), F.col("n_name").alias("name"))
    return best_fuzzy(n.select("block", F.concat(F.lit("the "), F.lower("name")).alias("query")), n, 50.0)


@query("s15_registry_payloads", "SELECT r_name AS query, n_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY (n_nationkey % 2 = 0) DESC, n_nationkey DESC)::INT AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n, r = t.table(spark, d, "nation"), t.table(spark, d, "region")
    code = F.when(F.col("n_nationkey") % 2 == 0, "US").otherwise("DE")
    org = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.struct(code.alias("country_code")).alias("country"))
    items = F.collect_list(F.struct(F.col("n_nationkey").cast("double").alias("score"), org.alias("organization")))
    bodies = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("query")).agg(F.to_json(F.struct(items.alias("items"))).alias("body"))
    return readers.parse_ror(bodies, "US").select("query", "name", "place")


@query("s16_point_lookups", "SELECT i AS n_nationkey, n_name, n_name IS NOT NULL AS found FROM range(40) r(i) LEFT JOIN nation ON n_nationkey = i")
def _(spark, d):
    ids = spark.range(40).select(F.col("id").alias("n_nationkey"))
    return readers.point_lookup(ids, t.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"), "n_nationkey")


@query("s17_author_match", "SELECT n_regionkey AS query, n_nationkey AS s2_id FROM nation WHERE CASE WHEN n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 10 = 0) THEN n_nationkey % 10 = 0 ELSE true END")
def _(spark, d):
    n = t.table(spark, d, "nation")
    hits = n.select(F.col("n_regionkey").alias("query"), F.col("n_nationkey").alias("s2_id"))
    return readers.authors_matching(hits, n.filter("n_nationkey % 10 = 0").select(F.col("n_nationkey").alias("s2_id")))


@query("s18_source_cascade", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS found_in FROM orders")
def _(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return readers.cascade([o.filter("k % 2 = 0").withColumn("found_in", F.lit(0)), o.filter("k % 3 = 0").withColumn("found_in", F.lit(1)), o.withColumn("found_in", F.lit(2))], "k")


@query("s21_document_text", "SELECT doc_id, left(text, 8000) AS raw FROM documents")
def _(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 8000).alias("raw"))


@query("s23_routed_search", sql("SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 'doi' ELSE 'title' END AS source FROM paper WHERE venue_key = '5-low'"))
def _(spark, d):
    from scholium.functions.text import source_of

    p = t.papers(spark, d).withColumn("categories", F.array("venue_key"))
    asked = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("paper_id").cast("string"))).otherwise("a title")
    return readers.search(p, ["5-low"]).select("paper_id", source_of(asked).alias("source"))


@query("f01_optional_predicates", sql("SELECT venue_key, paper.year, count(*)::BIGINT AS total FROM affil JOIN paper USING (paper_id) WHERE contains(venue_key, 'low') AND paper.year = 1996 GROUP BY ALL"))
def _(spark, d):
    return graph.industry_share(t.affiliated(spark, d), t.authored(spark, d), t.papers(spark, d), t.institutions(spark, d), venue="LOW", year=1996).select("venue_key", "year", "total")


@query("f02_contains", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '_1')")
def _(spark, d):
    return t.table(spark, d, "nation").filter(F.contains(F.lower("n_name"), F.lower(F.lit("_1")))).select("n_nationkey")


@query("f03_ordered_pairs", sql("SELECT DISTINCT x.country AS a, y.country AS b FROM inst x, inst y WHERE x.country <> '' AND y.country <> '' AND x.country < y.country"))
def _(spark, d):
    c = t.institutions(spark, d).select("country").distinct()
    return c.select(F.col("country").alias("a")).join(c.select(F.col("country").alias("b")), F.col("a") < F.col("b")).filter("a <> '' and b <> ''")


@query("f04_edge_threshold", sql("SELECT year, sum(papers_count)::BIGINT AS papers FROM collab WHERE papers_count >= 20 GROUP BY 1"))
def _(spark, d):
    return graph.collaborations(t.affiliated(spark, d)).filter("papers_count >= 20").groupBy("year").agg(F.sum("papers_count").alias("papers"))


@query("j18_contained_variant", "SELECT DISTINCT p_partkey, min(n_nationkey) OVER (PARTITION BY p_partkey) AS pos FROM part JOIN nation ON contains(lower('x nation_' || (p_partkey % 30)), lower(n_name))")
def _(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", F.concat(F.lit("x nation_"), (F.col("p_partkey") % 30).cast("string")).alias("text"))
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("v"))
    found = p.select("text").distinct().join(n, F.contains("text", F.col("v"))).groupBy("text").agg(F.min("pos").alias("pos"))
    return p.join(found, "text").select("p_partkey", "pos")


@query("t05_ordered_limit", sql("SELECT author_id, paper_id FROM (SELECT a.author_id, paper_id, row_number() OVER (PARTITION BY a.author_id ORDER BY p.year DESC, paper_id) AS k FROM authored a JOIN paper p USING (paper_id)) WHERE k <= 3"))
def _(spark, d):
    from pyspark.sql import Window

    rows = t.authored(spark, d).join(t.papers(spark, d).select("paper_id", "year"), "paper_id")
    turn = Window.partitionBy("author_id").orderBy(F.desc("year"), "paper_id")
    return rows.withColumn("k", F.row_number().over(turn)).filter("k <= 3").select("author_id", "paper_id")


@query("k06_rendered_table", "SELECT '| rank | name |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def _(spark, d):
    r = t.table(spark, d, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("name"))
    return spark.createDataFrame([(x,) for x in sinks.markdown_table(r, ["rank", "name"]).split("\n")], "line string")


def _stream(spark, d, files=1):
    schema = t.table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x06_stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    from scholium.streaming.progress import read_generation, upsert_sink

    out = scratch(spark, "stream")
    s = _stream(spark, d).select("user_id", "event_id")
    run = s.writeStream.foreachBatch(upsert_sink(f"{out}/table", ["user_id"], "event_id")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return read_generation(spark, f"{out}/table")


@query("x07_stream_windows", "SELECT * FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(spark, d):
    from scholium.streaming.progress import windowed_progress

    out = scratch(spark, "windows")
    s = windowed_progress(_stream(spark, d)).select("event_type", F.col("window.start").alias("day"), "n")
    run = s.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return spark.read.schema("event_type string, day timestamp, n bigint").parquet(f"{out}/rows").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("x01_stream_first_seen", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def _(spark, d):
    from scholium.streaming.progress import first_seen

    out = scratch(spark, "seen")
    s = first_seen(_stream(spark, d), ["user_id", "event_type"], "4000 days").select("user_id", "event_type")
    run = s.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(f"{out}/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("x10_stream_budget", REPLAY)
def _(spark, d):
    from scholium.streaming.progress import budget

    out = scratch(spark, "budget")
    s = _stream(spark, d).select(F.col("user_id").alias("budget"), "event_id", (F.col("event_id") % 90).alias("cost"), F.lit(900).alias("ceiling"))

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    run = budget(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("budget bigint, spent bigint, accepted bigint, epoch int").parquet(f"{out}/rows")
    return rows.groupBy("budget").agg(F.max_by("spent", "epoch").alias("spent"), F.max_by("accepted", "epoch").alias("accepted"))


_SPLIT = """, s AS (SELECT venue_key, CASE WHEN paper_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*)::BIGINT AS n, count(*) FILTER (title = 'F') / count(*) AS p, 1.96::DOUBLE AS z FROM paper GROUP BY ALL)
SELECT venue_key, split, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM s"""


@query("a36_by_split", sql(_SPLIT))
def _(spark, d):
    split = F.when(F.col("paper_id") % 5 == 0, "test").otherwise("train").alias("split")
    by = t.papers(spark, d).groupBy("venue_key", split).agg(F.count("*").alias("n"), F.count_if(F.col("title") == "F").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return by.select("venue_key", "split", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("x09_retries", """SELECT n_name AS query, CASE WHEN k < 3 THEN 'answer ' || n_name END AS body, least(k + 1, 3)::INT AS attempts, CASE WHEN k = 3 THEN 'Busy' END AS error
FROM (SELECT n_name, length(n_name) % 4 AS k FROM nation)""")
def _(spark, d):
    """A source that is busy for the first calls of a query: as many as its length leaves over four."""
    from scholium.sources.fetch import Busy, fetched

    def call(query: str, attempt: int) -> str:
        if attempt <= len(query) % 4:
            raise Busy(0.0)
        return f"answer {query}"

    return fetched(t.table(spark, d, "nation").select(F.col("n_name").alias("query")), call, per_second=1e6, attempts=3)
